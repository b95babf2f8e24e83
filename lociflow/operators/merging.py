"""Genealogies of neighbouring windows as one: inferred window by window, each with its own node numbers.

Samples, the nodes at time 0, have the same numbers in all windows, from 0 without gaps; a window's other nodes follow. They are numbered on by
how many the windows before have, a running sum over the windows' counts. Positions inside a window are shifted to where it begins.

windows: (window, left, right); edges: (window, left, right, parent, child); nodes: (window, node, time); both with a member, if each window holds an
ensemble: then members that any window lacks are left out, as they can't be joined. Windows that no edge lies in count nothing. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable_windows(windows: DataFrame, gaps: DataFrame, width: float) -> DataFrame:
    """The windows (window, left, right) that no gap (left, right) touches; both meet in bins of the axis."""
    from lociflow.operators import intervals as iv

    axis = F.lit(0).alias("axis")
    touched = iv.overlap_join(windows.select(axis, "window", "left", "right"), gaps.select(axis, "left", "right"), ["axis"], width)
    return windows.join(touched.select("window").distinct(), "window", "left_anti")


def common_members(nodes: DataFrame, windows: DataFrame) -> DataFrame:
    """(member) that every window has."""
    met = nodes.select("window", "member").distinct().join(windows.select("window").distinct(), "window")
    return met.groupBy("member").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == F.lit(windows.select("window").distinct().count())).select("member")


def merged(edges: DataFrame, nodes: DataFrame, windows: DataFrame, local: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) over the whole axis; local: positions count from their window's beginning."""
    who = ["member"] if "member" in nodes.columns else []
    windows = windows.select("window", F.col("left").alias("__from"), F.col("right").alias("__to"))
    if who:
        kept = common_members(nodes, windows)
        edges, nodes = edges.join(kept, "member"), nodes.join(kept, "member")
    placed = nodes.join(windows, "window")
    counts = placed.groupBy(*who, "window", "__from").agg(F.count_if(F.col("time") > 0).alias("__inner"), F.count_if(F.col("time") == 0).alias("__samples"))
    # one row a window and member
    ahead = W.partitionBy(*who).orderBy("__from").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*who, "window", "__samples", F.coalesce(F.sum("__inner").over(ahead), F.lit(0)).alias("__ahead"))
    shift = lambda c: F.when(F.col(c) >= F.col("__samples"), F.col(c) + F.col("__ahead")).otherwise(F.col(c))
    numbered = placed.join(counts, [*who, "window"]).select(*who, shift("node").alias("node"), "time").distinct()
    begin = F.col("__from") if local else F.lit(0.0)
    rows = edges.join(counts, [*who, "window"]).join(windows, "window")
    rows = rows.select(*who, F.greatest(F.col("left") + begin, "__from").alias("left"), F.least(F.col("right") + begin, "__to").alias("right"), shift("parent").alias("parent"), shift("child").alias("child"))
    return rows.where("left < right"), numbered


def sampled(nodes: DataFrame, branches: DataFrame, length: float | None = None, least: float = 1e-4, block: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a sampler's tables: nodes (node, time) numbered from 0, branches (left, right, parent, child).

    Times above 0 are raised to at least `least` more than those of all nodes before, as the sampler rounds them: a running maximum over the nodes' numbers, taken in blocks of so many, whose
    own maxima are carried on. Branches without a parent (below 0) are left out.
    """
    inner = nodes.where("time > 0").withColumn("__block", F.floor(F.col("node") / F.lit(block)))
    blocks = inner.groupBy("__block").agg(F.count(F.lit(1)).alias("__c"))
    order = W.orderBy("__block")
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__c").over(order.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("__block").orderBy("node")
    # after the i-th raise by `least` at a time, what counts is the time less i steps
    ranked = inner.join(blocks, "__block").withColumn("__i", F.col("__before") + F.row_number().over(inside)).withColumn("__x", F.col("time") - F.col("__i") * F.lit(least))
    tops = ranked.groupBy("__block").agg(F.max("__x").alias("__m"))
    tops = tops.withColumn("__top", F.max("__m").over(W.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(W.unboundedPreceding, -1))).drop("__m")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    raised = ranked.join(tops, "__block").select("node", (F.greatest(F.max("__x").over(upto), F.col("__top")) + F.col("__i") * F.lit(least)).alias("time"))
    edges = branches.where("parent >= 0")
    if length is not None:
        edges = edges.withColumn("right", F.least("right", F.lit(float(length)))).where("left < right")
    return edges.select("left", "right", "parent", "child"), nodes.where("time = 0").select("node", "time").unionByName(raised)


def sites(mutations: DataFrame, length: float) -> DataFrame:
    """(pos, node, state) of a sampler's mutations (pos, node, upper, state) without the closing mark at the axis' end; rows that repeat are one."""
    return mutations.where(F.col("pos") < F.lit(float(length))).select("pos", "node", "state").distinct()
