"""Mixing sources to target weights.

Every document gets a hash-random key; within its source the documents stand in key order; distributed prefix sums of
their sizes cut each source at its exact budget, whole epochs first. The keys are spread evenly, so key ranges of
equal width are balanced range partitions of any source, however large: sizes are summed by (source, range), the ranges'
sums are accumulated by source, and only inside a range are documents sorted.

A null text has size 0 and takes nothing; texts of any length are counted whole; a null source is a source of its own, last in order.
Documents with equal keys follow by id, then size, so repeated rows share a cut in one defined way. Empty tables give empty results.
Input columns named like a new column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociflow.cluster import Stored

#: Weights of the sources in code-point order, repeating; most epochs; documents in a key range, about.
WEIGHTS, MOST_EPOCHS, RANGE_ROWS = (1, 2, 3), 3, 4_000
#: One row a source is broadcast up to so many sources, and joined by a shuffle beyond.
FEW_SOURCES = 10_000


def size_of(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): all sizes together, shared by weight.

    Targets stop at `most` times their source's size and the excess is reshared by weight until none is above. With
    the sources in order of most * size / weight those that stop are the first; a source stops exactly if the level
    (what the stopped leave, over the weights not stopped) reaches its own ratio. One row a source: few rows.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(weights)
    rows = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int")))
    rows = rows.withColumns({"cap": F.lit(float(most)) * F.col("source_size"), "ratio": F.lit(float(most)) * F.col("source_size") / F.col("w")})
    every = W.partitionBy(F.lit(0))
    before = W.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    rows = rows.withColumn("stops", F.col("left") >= F.col("ratio") * F.col("open"))
    level = F.min(F.when(~F.col("stops"), F.struct("ratio", (F.col("left") / F.col("open")).alias("level")))).over(every)["level"]
    return rows.select("source", F.col("source_size").cast("long").alias("source_size"), F.when(F.col("stops") | level.isNull(), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def mix(df: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, range_rows: int = RANGE_ROWS, size: Column | None = None) -> DataFrame:
    """df with size, source_size, target (its source's) and taken (words the mix takes, repeats counted); columns of df with these names are replaced.

    size: where the sizes stand already, so the texts (read several times otherwise) aren't needed. The cut falls inside a document where the budget does: in the last epoch `taken` is then a part of its size.
    """
    names = [c for c in df.columns if c not in ("size", "source_size", "target", "taken")]
    key = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{source_col}`").alias("__source"), F.col(f"`{id_col}`").alias("__id"), (size_of(F.col(f"`{text_col}`")) if size is None else size).alias("size"), key.alias("__key"))
    totals = rows.groupBy("__source").agg(F.sum("size").alias("source_size"), F.ceil(F.count(F.lit(1)) / F.lit(range_rows)).alias("__ranges"))
    goals = targets(totals.select(F.col("__source").alias("source"), "source_size"), weights, most)
    plan = goals.join(totals.select(F.col("__source"), "__ranges"), F.col("source").eqNullSafe(F.col("__source"))).select(F.col("source").alias("__planned"), "source_size", "target", "__ranges")
    rows = rows.join(plan, F.col("__source").eqNullSafe(F.col("__planned"))).drop("__planned")
    place = F.conv(F.substring("__key", 1, 7), 16, 10).cast("long")  # 28 bits of the key, spread evenly
    rows = rows.withColumn("__range", F.floor(place * F.col("__ranges") / F.lit(1 << 28)))
    sums = rows.groupBy("__source", "__range").agg(F.sum("size").alias("__sum"))
    ahead = W.partitionBy("__source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("__source").alias("__s"), F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    rows = rows.join(sums, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r"))).drop("__s", "__r")
    inside = W.partitionBy("__source", "__range").orderBy("__key", "__id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__ahead", F.col("__ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - full * F.col("source_size") - F.col("__ahead")
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select(*[F.col(f"`{c}`") for c in names], "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeated(df: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The mix as documents: each as often as it is taken, a part counted as a whole; documents not taken go.

    The columns stay as they are. Only ids, sources and sizes are shuffled: what the texts meet is one row a source, with
    its epochs and the last document before its cut.
    """
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size_of(F.col(f"`{text_col}`")).alias("words"))
    narrow = Stored(narrow, "sizes")
    mixed = mix(narrow.df, "", "source", "id", size=F.col("words"), **options)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    part = F.col("taken") > epochs * F.col("size")
    cuts = Stored(mixed.groupBy(F.col("source").alias("__source")).agg(F.max(epochs).cast("int").alias("__epochs"), F.max(F.when(part, F.struct(key.alias("k"), F.col("id").alias("i"), F.col("size").alias("z")))).alias("__cut")), "cuts").df
    narrow.drop()
    if cuts.count() <= FEW_SOURCES:
        cuts = F.broadcast(cuts)
    size = size_of(F.col(f"`{text_col}`"))
    place = F.struct(F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("k"), F.col(f"`{id_col}`").alias("i"), size.alias("z"))
    copies = F.when(size > 0, F.col("__epochs") + F.when(place <= F.col("__cut"), F.lit(1)).otherwise(F.lit(0))).otherwise(F.lit(0))
    joined = df.join(cuts, F.col(f"`{source_col}`").eqNullSafe(F.col("__source"))).withColumn("__copies", copies).where("__copies > 0")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in df.columns])
