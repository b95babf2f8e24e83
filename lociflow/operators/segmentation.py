"""Hard segmentation of posterior tracks with a deadband."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociflow.operators.intervals import merge_runs
from lociflow.operators.metrics import top


def hard_segments(tracks: DataFrame, states: list[str], deadband: float = 0.0) -> DataFrame:
    """(sample, left, right, state): tracts of anchors (informative spans whose two best states differ by the deadband or more).

    Spans between equal anchors take their state, those before the first and after the last that of the nearest. Between
    different anchors the border is the change of the top state nearest to the middle of the gap; of two equally near ones the
    spans are split by their own centres, and a centre on the middle takes the lower state. A sample without
    anchors takes the state of the largest total probability.
    """
    p = F.sort_array(F.array(*states), asc=False)
    anchored = (F.col("status") == "informative") & (p[0] - p[1] >= F.lit(float(deadband)))
    every, order = W.partitionBy("sample"), W.partitionBy("sample").orderBy("left")
    back, ahead = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    width = F.col("right") - F.col("left")
    rows = tracks.withColumns({"top": top(states), "anchor": anchored})
    rows = rows.withColumns({"a": F.when(F.col("anchor"), F.col("top")), "al": F.when(F.col("anchor"), F.col("left")), "ar": F.when(F.col("anchor"), F.col("right"))})
    rows = rows.withColumns({"pa": F.last("a", True).over(back), "pr": F.last("ar", True).over(back), "na": F.first("a", True).over(ahead), "nl": F.first("al", True).over(ahead), "before": F.lag("top").over(order), **{f"sum_{s}": F.sum(F.col(s) * width).over(every) for s in states}})
    # a change of the top state may be a border where this span and its predecessor stand in one gap between different anchors
    rows = rows.withColumns({"lpa": F.last("a", True).over(order.rowsBetween(W.unboundedPreceding, -1)), "lpr": F.last("ar", True).over(order.rowsBetween(W.unboundedPreceding, -1))})
    rows = rows.withColumn("mid", F.lit(0.5) * (F.col("lpr") + F.col("nl")))
    split = F.col("lpa").isNotNull() & F.col("na").isNotNull() & (F.col("lpa") != F.col("na"))
    rows = rows.withColumn("far", F.when(split & (F.col("before") != F.col("top")), F.abs(F.col("left") - F.col("mid"))))
    gap = W.partitionBy("sample", "lpr", "nl")
    rows = rows.withColumn("least", F.min("far").over(gap))
    near = F.when(F.col("far") <= F.col("least") + 1e-9, F.col("left"))
    rows = rows.withColumns({"ties": F.count(near).over(gap), "border": F.min(near).over(gap)})
    centre = F.lit(0.5) * (F.col("left") + F.col("right"))
    tied = F.when(centre < F.col("mid"), F.col("lpa")).when(centre > F.col("mid"), F.col("na")).otherwise(F.least("lpa", "na"))
    inside = F.when(F.col("ties") >= 2, tied).otherwise(F.when(F.col("left") < F.col("border"), F.col("lpa")).otherwise(F.col("na")))
    none = top([f"sum_{s}" for s in states])
    state = F.when(F.col("anchor"), F.col("top")).when(F.col("pa").isNull() & F.col("na").isNull(), none).when(F.col("pa").isNull(), F.col("na")).when(F.col("na").isNull(), F.col("pa")).when(F.col("pa") == F.col("na"), F.col("pa")).otherwise(inside)
    return merge_runs(rows.select("sample", "left", "right", state.cast("int").alias("state")), ["sample"], ["state"])
