"""Trees, edges and nodes of genealogies held as interval-keyed edge tables (left, right, parent, child)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.cluster import Stored
from lociflow.operators.intervals import merge_runs, points_in, running
from lociflow.operators.order import ranked


def trees(edges: DataFrame, length: float, width: float) -> DataFrame:
    """(tree, left, right): the axis cut wherever an edge begins or ends; no edge and node pair is expanded."""
    points = edges.select(F.explode(F.array("left", "right")).alias("left")).unionAll(edges.sparkSession.createDataFrame([(0.0,), (float(length),)], "left double"))
    points = points.where((F.col("left") >= 0) & (F.col("left") <= F.lit(float(length))))
    return ranked(points, "left", width).where("following IS NOT NULL").select(F.col("rank").alias("tree"), "left", F.col("following").alias("right"))


def edge_span_summary(edges: DataFrame) -> DataFrame:
    span = F.col("right") - F.col("left")
    return edges.agg(F.count(F.lit(1)).alias("n"), F.percentile(span, 0.5).alias("median"), F.avg(span).alias("mean"), F.min(span).alias("least"), F.max(span).alias("most"))


def node_persistence(edges: DataFrame, tree_table: DataFrame, width: float) -> DataFrame:
    """(node, trees): in how many trees each parent or child stands. Runs of a node are joined first, then measured in tree numbers."""
    nodes = edges.select("left", "right", F.explode(F.array(F.concat(F.lit("p"), "parent"), F.concat(F.lit("c"), "child"))).alias("node"))
    covered = coverage(nodes, "node", width)
    index = tree_table.select(F.col("left").alias("at"), "tree")
    end = tree_table.select(F.col("right").alias("at"), (F.col("tree") + 1).alias("tree"))
    begun = covered.join(index.withColumnRenamed("tree", "first"), F.col("left") == F.col("at")).drop("at")
    closed = begun.join(end.withColumnRenamed("tree", "last"), F.col("right") == F.col("at")).drop("at")
    return closed.groupBy("node").agg(F.sum(F.col("last") - F.col("first")).cast("long").alias("trees"))


def coverage(df: DataFrame, by: str, width: float) -> DataFrame:
    """The union of each key's intervals, which may overlap, as disjoint intervals: where the running sum of what begins and ends is above 0."""
    ends = df.select(by, F.explode(F.array(F.struct(F.col("left").alias("pos"), F.lit(1).alias("held")), F.struct(F.col("right").alias("pos"), F.lit(-1).alias("held")))).alias("end")).select(by, "end.*")
    return merge_runs(running(ends, by, "pos", ["held"], width).where("held > 0").drop("held"), [by], [], width)


def persistence_summary(persistence: DataFrame) -> DataFrame:
    return persistence.agg(F.count(F.lit(1)).alias("n"), F.percentile("trees", 0.5).alias("median"), F.max("trees").alias("most"), F.avg((F.col("trees") == 1).cast("double")).alias("share_of_one"))


def missing_mask(samples: DataFrame, tree_table: DataFrame, present: DataFrame, width: float) -> DataFrame:
    """(sample, left, right) where a sample is isolated: in no edge of the tree. present: (sample, left) of the trees that hold it.

    The trees' outer ends are taken once, and what lies between a sample's own stretches is found by its running sum: no sample meets
    a tree that doesn't hold it. tree_table: (left, right), without gaps.
    """
    held = present.select("sample", "left").distinct().join(tree_table.select("left", "right"), "left")
    first, last = tree_table.agg(F.min("left"), F.max("right")).first()
    if first is None:
        return held.select("sample", "left", "right").limit(0)
    ends = held.select("sample", F.explode(F.array(F.struct(F.col("left").alias("pos"), F.lit(1).alias("held")), F.struct(F.col("right").alias("pos"), F.lit(-1).alias("held")))).alias("end")).select("sample", "end.*")
    outer = samples.select("sample").distinct().withColumn("pos", F.explode(F.array(F.lit(float(first)), F.lit(float(last))))).withColumn("held", F.lit(0))
    return running(ends.unionByName(outer), "sample", "pos", ["held"], width).where("held = 0").select("sample", "left", "right")


def nearest_reference(leaves: DataFrame, parents: DataFrame, references: DataFrame) -> DataFrame:
    """(node, depth, label) of each leaf: the lowest ancestor above a reference other than the leaf itself.

    leaves: (node, rank, parent); parents: (node, parent, time) of inner nodes, one or more levels; references: (node, rank, label).
    Of several references below that ancestor the one of least rank gives the label. Leaves without any get nulls.
    """
    up = leaves.select("node", "rank", F.col("parent").alias("ancestor"))
    refs = up.join(references.select("node", "label"), "node").select("ancestor", "rank", "label")
    inner = parents.select(F.col("node").alias("ancestor"), F.col("parent").alias("above"), "time")
    out = None
    while True:
        # the two least references below each ancestor are enough to name one that is not the leaf, and all that goes further up
        least = refs.groupBy("ancestor").agg(F.min(F.struct("rank", "label")).alias("a"))
        second = refs.join(least, "ancestor").where(F.col("rank") > F.col("a.rank")).groupBy("ancestor").agg(F.min(F.struct("rank", "label")).alias("b"))
        two = Stored(least.join(second, "ancestor", "left").join(inner, "ancestor"), "nearest-references").df
        here = up.join(two, "ancestor", "left").withColumn("r", F.when(F.col("a.rank") != F.col("rank"), F.col("a")).otherwise(F.col("b")))
        here = Stored(here.select("node", "rank", "ancestor", F.col("time").alias("depth"), "r"), "nearest-leaves").df
        found = here.where("r IS NOT NULL").select("node", "depth", "r.label")
        out = found if out is None else out.unionByName(found)
        up = here.where("r IS NULL").join(inner, "ancestor").select("node", "rank", F.col("above").alias("ancestor")).where("ancestor IS NOT NULL")
        if up.isEmpty():
            break
        refs = two.select(F.col("above").alias("ancestor"), F.explode(F.filter(F.array("a", "b"), lambda x: x.isNotNull())).alias("r")).where("ancestor IS NOT NULL").select("ancestor", "r.*")
    return leaves.select("node").join(out, "node", "left")


def tree_rows(edges: DataFrame, nodes: DataFrame, tree_table: DataFrame, width: float) -> DataFrame:
    """(tree, node, parent, ...) of every node in every tree, a root's parent null: for inspection, as it writes each tree out. nodes: (node, ...)."""
    at = tree_table.select(F.lit(0).alias("axis"), "tree", F.col("left").alias("at"))
    held = points_in(at, edges.withColumn("axis", F.lit(0)), ["axis"], "at", width).select("tree", "parent", "child")
    below = held.select("tree", F.col("child").alias("node"), "parent")
    roots = held.select("tree", F.col("parent").alias("node")).distinct().join(below.select("tree", "node"), ["tree", "node"], "left_anti")
    return below.unionByName(roots.withColumn("parent", F.lit(None).cast("long"))).join(nodes, "node")
