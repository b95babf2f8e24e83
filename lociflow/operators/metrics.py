"""Accuracy, calibration and fragmentation of tracks against a truth.

Overlaps are rows (sample, lo, hi, p0.., status, state) of intervals.overlap_join. Spans with missing information don't
count unless a metric says so; a metric without any span is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.operators.intervals import nearest, neighbours


def span() -> Column:
    return F.col("hi") - F.col("lo")


def top(states: list[str]) -> Column:
    """The most probable state; the lowest index of equals."""
    p = F.array(*states)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def informative(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "informative")


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(F.sum(part), F.sum(whole))


def per_base_accuracy(overlaps: DataFrame, states: list[str]) -> DataFrame:
    hit = F.when(top(states) == F.col("state"), span()).otherwise(0.0)
    return informative(overlaps).agg(F.count(F.lit(1)).alias("n"), ratio(hit, span()).alias("accuracy"))


def balanced_accuracy(overlaps: DataFrame, states: list[str]) -> DataFrame:
    hit = F.when(top(states) == F.col("state"), span()).otherwise(0.0)
    return informative(overlaps).groupBy("state").agg(ratio(hit, span()).alias("a")).agg(F.count(F.lit(1)).alias("classes"), F.avg("a").alias("balanced_accuracy"))


def mean_confidence(tracks: DataFrame, states: list[str]) -> DataFrame:
    k, width = len(states), F.col("right") - F.col("left")
    certain = (F.greatest(*states) - F.lit(1.0 / k)) / F.lit(1.0 - 1.0 / k)
    return informative(tracks).agg(ratio(certain * width, width).alias("confidence"))


def proportions(tracks: DataFrame, states: list[str]) -> DataFrame:
    width = F.col("right") - F.col("left")
    return informative(tracks).agg(*[ratio(F.col(s) * width, width).alias(f"share_{s}") for s in states])


def true_proportions(truth: DataFrame) -> DataFrame:
    width = F.col("right") - F.col("left")
    total = truth.agg(F.sum(width).alias("t"))
    return truth.groupBy("state").agg(F.sum(width).alias("w")).join(F.broadcast(total)).select("state", (F.col("w") / F.col("t")).alias("share"))


def reliability_curve(overlaps: DataFrame, state: str, index: int, bins: int = 10) -> DataFrame:
    """Mean probability and observed share of a state by probability bin; empty bins don't appear."""
    place = F.least(F.floor(F.col(state) * bins), F.lit(bins - 1)).cast("int")
    seen = F.when(F.col("state") == index, span()).otherwise(0.0)
    return informative(overlaps).groupBy(place.alias("bin")).agg(ratio(F.col(state) * span(), span()).alias("predicted"), ratio(seen, span()).alias("observed"), F.sum(span()).alias("weight"))


def _steps(tracks: DataFrame, states: list[str], width: float | None = None) -> DataFrame:
    """A row for each boundary of two informative neighbours: its position, the change of p0 and whether the top state flips."""
    rows = neighbours(tracks.select("sample", "left", "status", F.col(states[0]).alias("p"), top(states).alias("s")), ["sample"], "left", ["p", "s", "status"], [], width)
    rows = rows.where("status = 'informative' AND __before.status = 'informative'")
    return rows.select("sample", F.col("left").alias("pos"), F.abs(F.col("p") - F.col("__before.p")).alias("step"), (F.col("s") != F.col("__before.s")).cast("int").alias("flip"))


def flicker(tracks: DataFrame, states: list[str], width: float | None = None) -> DataFrame:
    return _steps(tracks, states, width).agg(F.count(F.lit(1)).alias("boundaries"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("mean_step"), F.coalesce(F.avg("flip"), F.lit(0.0)).alias("flip_rate"))


def flicker_by_truth(tracks: DataFrame, states: list[str], true_switches: DataFrame, tolerance: float, width: float | None = None) -> DataFrame:
    """Flicker of boundaries within `tolerance` of a true switch, and of the others."""
    steps = _steps(tracks, states, width)
    near = nearest(steps.select("sample", "pos"), true_switches, ["sample"], width=width).select("sample", "pos", (F.col("distance") <= tolerance).alias("at_true"))
    return steps.join(near, ["sample", "pos"]).groupBy("at_true").agg(F.count(F.lit(1)).alias("boundaries"), F.avg("step").alias("mean_step"), F.avg("flip").alias("flip_rate"))


def boundary_error(true_switches: DataFrame, found_switches: DataFrame, width: float | None = None) -> DataFrame:
    """Median and mean distance from true switches to the nearest found one (infinity without one)."""
    d = nearest(true_switches, found_switches, ["sample"], width=width)
    return d.agg(F.count(F.lit(1)).alias("n"), F.percentile("distance", 0.5).alias("median"), F.avg("distance").alias("mean"))


def breakpoint_scores(true_switches: DataFrame, found_switches: DataFrame, tolerance: float, width: float | None = None) -> DataFrame:
    """Share of found switches near a true one and of true ones near a found one, averaged over the samples that have any."""

    def share(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        near = nearest(a, b, ["sample"], width=width).groupBy("sample").agg(F.avg((F.col("distance") <= tolerance).cast("double")).alias("x"))
        return near.agg(F.avg("x").alias(name))

    return share(found_switches, true_switches, "precision").join(F.broadcast(share(true_switches, found_switches, "recall")))  # one row each


def switch_density(track_switches: DataFrame, samples: DataFrame, length: float) -> DataFrame:
    counts = track_switches.groupBy("sample").agg(F.count(F.lit(1)).alias("c"))
    rows = samples.join(counts, "sample", "left").select("sample", F.coalesce("c", F.lit(0)).alias("switches"))
    return rows.withColumn("density", F.col("switches") / F.lit(length))


def accuracy_by_size(overlaps_with_size: DataFrame, states: list[str], edges: list[float]) -> DataFrame:
    """Accuracy by the length of the true segment (column `size`); a segment counts before missing spans go; all bins appear."""
    spark = overlaps_with_size.sparkSession
    bins = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bin int, low double, high double")
    place = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        place = F.when((F.col("size") >= edges[i]) & (F.col("size") < edges[i + 1]), i).otherwise(place)
    ok = F.col("status") == "informative"
    rows = overlaps_with_size.withColumn("bin", place).where("bin IS NOT NULL")
    hit = F.when(ok & (top(states) == F.col("state")), span()).otherwise(0.0)
    got = rows.groupBy("bin").agg(F.count_distinct("sample", "segment").alias("c"), ratio(hit, F.when(ok, span()).otherwise(0.0)).alias("accuracy"))
    return bins.join(F.broadcast(got), "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("segments"), "accuracy")


def aggregate(scores: DataFrame) -> DataFrame:
    """(scenario, painter, metric, n, mean, deviation) over the seeds of scores (scenario, painter, seed, metric, value); null and NaN values don't count."""
    rows = scores.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy("scenario", "painter", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
