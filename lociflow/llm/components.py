"""Connected components of links held in DataFrames, by alternating stars; nothing but counters reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.cluster import Stored


#: Parts that the links of one node are dealt to.
PARTS = 128


def _with_least(links: DataFrame) -> DataFrame:
    """(u, v) with m, the smallest v of the same u. A node with many links is spread over PARTS keys both times: first each
    part's least is taken, then the parts' leasts, at most PARTS a node, and these go back to the parts that have links."""
    parted = links.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    least = parted.groupBy("u", "part").agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("parts"))
    return parted.join(least.select("u", "m", F.explode("parts").alias("part")), ["u", "part"]).select("u", "v", "m")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang each node's larger neighbours (small: the others, and itself) on the smallest node near it."""
    if small:
        near = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        return near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(near.select("u", F.col("m").alias("v"))).distinct()
    near = _with_least(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    Links may repeat, point either way or join a node to itself; null ends are ignored. Every round is written to the
    shared folder, so a lost executor repeats no earlier round.
    """
    now = Stored(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        after = Stored(_star(_star(now.df, small=False), small=True), "links")
        state = after.df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
        now.drop()
        now = after
        if state.n == 0 or mark == (state.n, state.s, state.x):
            break
        mark = (state.n, state.s, state.x)
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
