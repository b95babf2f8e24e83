"""The engine's tables from general business tables, by fixed arithmetic: tracks, truth, forests, genotypes, depths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators.intervals import tile_markers

#: Length of the event axis in seconds (30 days), of a tile of the truth, and of a bin of the axis.
LENGTH, TILE, BIN = 2_592_000.0, 21_600.0, 345_600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, pos, event_id, event_type, value): seconds since the start of the axis."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), (micros / F.lit(1e6)).alias("pos"), "event_id", "event_type", "value")


def event_tracks(spark: SparkSession, sf_dir: str, scale: float = 50.0, thin: int | None = None) -> DataFrame:
    """Posterior tracks (sample, left, right, p0, p1, status) whose markers are a user's events."""
    markers = event_markers(spark, sf_dir)
    if thin is not None:
        markers = markers.where(F.col("event_id") % 3 != thin)
    tiled = tile_markers(markers, ["sample"], "pos", LENGTH, ["event_id"], BIN)
    p0 = F.col("value") / (F.col("value") + F.lit(scale))
    return tiled.select("sample", "left", "right", p0.alias("p0"), (F.lit(1.0) - p0).alias("p1"), F.when(F.col("event_type") == "error", "missing-info").otherwise("informative").alias("status"))


def event_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True states (sample, left, right, state) in equal tiles."""
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample")).distinct()
    tiles = samples.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(int(LENGTH / TILE) - 1))))
    return tiles.select("sample", (F.col("k") * F.lit(TILE)).alias("left"), ((F.col("k") + 1) * F.lit(TILE)).alias("right"), ((F.col("sample") + F.col("k")) % 2).cast("int").alias("state"))


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three members with their own scales and their own breakpoints."""
    found = None
    for member, scale in enumerate((30.0, 50.0, 80.0)):
        one = event_tracks(spark, sf_dir, scale, member).withColumn("member", F.lit(member))
        found = one if found is None else found.unionByName(one)
    return found


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (node, parent, time, level, label, w): customers under nations under regions; label 1 for a negative balance."""
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.lit(0.0).alias("time"), F.lit(0).alias("level"), (F.col("c_acctbal") < 0).cast("int").alias("label"), F.when(F.col("c_mktsegment") == "BUILDING", 0.2).otherwise(0.1).alias("w"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit(2.0).alias("time"), F.lit(1).alias("level"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("w"))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(3.0).alias("time"), F.lit(2).alias("level"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("w"))
    return customers.unionByName(nations).unionByName(regions)


def edge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (left, right, parent, child) of nations over customers from a customer's first order day to the day after its last."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(days).alias("left"), (F.max(days) + 1.0).alias("right"))
    return spans.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("left", "right", F.col("c_nationkey").cast("long").alias("parent"), F.col("c_custkey").alias("child"))


def woven(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of three states: edge_intervals with nations numbered below zero, at time 2; customers at time 0.

    A customer's balance gives its state, every fourth customer has none; nodes: (node, time, label, w).
    """
    edges = edge_intervals(spark, sf_dir).withColumn("parent", -1 - F.col("parent"))
    balance, key = F.col("c_acctbal"), F.col("c_custkey")
    label = F.when(key % 4 != 0, F.when(balance < 0, 0).when(balance < 5000, 1).otherwise(2))
    customers = table(spark, sf_dir, "customer").select(key.cast("long").alias("node"), F.lit(0.0).alias("time"), label.cast("int").alias("label"), F.when(F.col("c_mktsegment") == "BUILDING", 0.5).otherwise(0.8).alias("w"))
    nations = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("node"), F.lit(2.0).alias("time"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("w"))
    return edges.select("left", "right", "parent", F.col("child").cast("long").alias("child")), customers.unionByName(nations)


#: The layered genealogy: length of its axis in days; times of customers, nations, regions and the root.
DAYS, TIMES = 4000.0, (0.0, 2.0, 3.0, 5.0)


def layered(spark: SparkSession, sf_dir: str, later: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of four levels that all change along the axis: customers under nations as in woven(), nations under regions under one root.

    A nation moves to the next region at day 600 + 40 * its key + later; a region has no parent for 200 days from day 1000 + 100 * its key. Nations are
    numbered from -1 down, regions from -101, the root is -1000.
    """
    edges, nodes = woven(spark, sf_dir)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key, at = F.col("n_nationkey").cast("long"), F.lit(600.0 + later) + 40.0 * F.col("n_nationkey")
    over = lambda left, right, parent, child: F.struct(F.lit(left).alias("left") if isinstance(left, float) else left.alias("left"), F.lit(right).alias("right") if isinstance(right, float) else right.alias("right"), parent.cast("long").alias("parent"), child.cast("long").alias("child"))
    moves = F.array(over(0.0, at, -101 - F.col("n_regionkey"), -1 - key), over(at, DAYS, -101 - (F.col("n_regionkey") + 1) % 5, -1 - key))
    gap = F.lit(1000.0) + 100.0 * F.col("r_regionkey")
    tops = F.array(over(0.0, gap, F.lit(-1000), -101 - F.col("r_regionkey")), over(gap + 200.0, DAYS, F.lit(-1000), -101 - F.col("r_regionkey")))
    edges = edges.unionByName(nation.select(F.explode(moves).alias("e")).select("e.*")).unionByName(region.select(F.explode(tops).alias("e")).select("e.*"))
    bare = lambda node, time: [node.cast("long").alias("node"), F.lit(time).alias("time"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("w")]
    nodes = nodes.unionByName(region.select(*bare(-101 - F.col("r_regionkey"), TIMES[2]))).unionByName(spark.range(1).select(*bare(F.lit(-1000), TIMES[3])))
    return edges, nodes
