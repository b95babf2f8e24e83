"""Small steps around painting: counts in ranges, draws after burn-in, names, members of all windows, seams, tract scores, ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociflow.cluster import Stored
from lociflow.operators import intervals as iv

#: A table of names (populations, states) is broadcast up to so many rows, and joined by a shuffle beyond.
FEW_NAMES = 10_000


def range_count(intervals: DataFrame, points: DataFrame, by: list[str], pos: str, width: float, as_col: str = "n") -> DataFrame:
    """intervals with the number of the key's points in each (left <= pos < right); 0 where there is none. Equal intervals count alike."""
    spans = [*by, "left", "right"]
    held = iv.points_in(points.select(*by, pos), intervals.select(*spans).distinct(), by, pos, width).groupBy(*spans).agg(F.count(F.lit(1)).alias(as_col))
    return intervals.join(held, spans, "left").withColumn(as_col, F.coalesce(as_col, F.lit(0)))


def keep_draws(draws: DataFrame, by: list[str], index: list[str], burn_in: int, keep: int) -> DataFrame:
    """The last `keep` draws of each chain after its first `burn_in`; index puts a chain's draws in order."""
    up, down = W.partitionBy(*by).orderBy(*index), W.partitionBy(*by).orderBy(*[F.col(c).desc() for c in index])
    rows = draws.withColumns({"__up": F.row_number().over(up), "__down": F.row_number().over(down)})
    return rows.where((F.col("__up") > burn_in) & (F.col("__down") <= keep)).drop("__up", "__down")


def first_seen(df: DataFrame, by: list[str], value: str, index: str) -> DataFrame:
    """Each value of a key once, with where it first came: sorted by that, the key's values in order without repeats."""
    return df.groupBy(*by, value).agg(F.min(index).alias(index))


def in_all_windows(df: DataFrame, member: str, window: str) -> DataFrame:
    """(member): those that have a row in every window that occurs."""
    windows = df.agg(F.count_distinct(window)).first()[0]
    return df.groupBy(member).agg(F.count_distinct(window).alias("__n")).where(F.col("__n") == F.lit(windows)).select(member)


def stitch(parts: DataFrame, by: list[str], values: list[str], width: float) -> DataFrame:
    """Tracks painted window by window, put together: stretches that a window's edge cut in two are one again where their values agree."""
    return iv.merge_runs(parts, by, values, width)


def tract_scores(found: DataFrame, true: DataFrame, by: list[str], width: float) -> DataFrame:
    """One row: recall (share of the true length that is found), precision (share of the found length that is true), both null for no length."""
    span = F.col("right") - F.col("left")
    both = iv.overlap_join(found.select(*by, "left", "right"), true.select(*by, "left", "right"), by, width).select((F.col("hi") - F.col("lo")).alias("o"), F.lit(0.0).alias("f"), F.lit(0.0).alias("t"))
    lengths = found.select(F.lit(0.0).alias("o"), span.alias("f"), F.lit(0.0).alias("t")).unionAll(true.select(F.lit(0.0).alias("o"), F.lit(0.0).alias("f"), span.alias("t")))
    return both.unionAll(lengths).agg(F.try_divide(F.sum("o"), F.sum("t")).alias("recall"), F.try_divide(F.sum("o"), F.sum("f")).alias("precision"))


def purity(segments: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """(by, label, purity): the share of a reference's length whose state is its label. segments: (by, left, right, state); labels: (by, label)."""
    span = F.col("right") - F.col("left")
    rows = segments.join(labels, by)
    return rows.groupBy(by, "label").agg((F.sum(F.when(F.col("state") == F.col("label"), span).otherwise(0.0)) / F.sum(span)).alias("purity"))


def one_hot(segments: DataFrame, states: int) -> DataFrame:
    """Hard segments as tracks: p0, p1, ... are 1 for the state and 0 for the others; a null state has missing information and even shares."""
    known = F.col("state").isNotNull()
    shares = {f"p{k}": F.when(known, (F.col("state") == k).cast("double")).otherwise(F.lit(1.0 / states)) for k in range(states)}
    return segments.withColumns({**shares, "status": F.when(known, "informative").otherwise("missing-info")}).drop("state")


def over_members(df: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(by..., n, mean, median, low, high) over the members' finite values: the middle `level` of them lies between low and high."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    at = lambda q: F.percentile(value, q)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), at(0.5).alias("median"), at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))


def first_ancestor(start: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, ancestor): the nearest node above (or the node itself) that is marked, null where none is.

    start: (node); parents: (node, parent, marked). One join a level, for all nodes at once.
    """
    inner = parents.select(F.col("node").alias("at"), "parent", "marked")
    up = Stored(start.select("node", F.col("node").alias("at")), "climbing")
    out = None
    while True:
        here = Stored(up.df.join(inner, "at", "left"), "climbed").df
        found = here.where("marked").select("node", F.col("at").alias("ancestor"))
        out = found if out is None else out.unionByName(found)
        rest = here.where("NOT coalesce(marked, false) AND parent IS NOT NULL").select("node", F.col("parent").alias("at"))
        up = Stored(rest, "climbing")
        if up.df.isEmpty():
            return start.select("node").join(out, "node", "left")


def split_names(name: Column) -> tuple[Column, Column]:
    """(individual, haplotype from 1) of a haplotype's name: `_` and a number from 0 at its end; others are their own first haplotype."""
    number = F.regexp_extract(name, r"_(\d+)$", 1)
    return F.regexp_replace(name, r"_\d+$", ""), F.when(number != "", number.cast("long") + 1).otherwise(F.lit(1).cast("long"))


def map_states(segments: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """segments with the state of their population; names: (name, state). Populations without a state get null."""
    few = names.limit(FEW_NAMES + 1).count() <= FEW_NAMES
    return segments.join(F.broadcast(names) if few else names, name, "left").drop(name)


def subset(sites: DataFrame, pos: str, start: float | None = None, end: float | None = None, names: list[str] | None = None, name: str = "name") -> DataFrame:
    """Rows with start <= pos < end of the chosen samples: a name stands for itself and for all that begin with it and `_`."""
    rows = sites
    if start is not None:
        rows = rows.where(F.col(pos) >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col(pos) < F.lit(end))
    if names is not None:
        hit = F.col(name).isin(*names)
        for n in names:
            hit = hit | F.startswith(name, F.lit(n + "_"))
        rows = rows.where(hit)
    return rows
