"""Command line for spark-submit: analytical steps from parquet tables to parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import numpy as np

from lociflow.operators import chains, dating, ghosts, intervals, metrics, mutations, nearest, painters, references, weave
from lociflow.operators.segmentation import hard_segments
from lociflow.sources import arrays, stores
from lociflow.streaming.painting import paint_windows


def _states(o: argparse.Namespace) -> list[str]:
    return [f"p{k}" for k in range(o.states)]


def _start(o: argparse.Namespace) -> tuple[np.ndarray, np.ndarray]:
    """(generator, root distribution): those of a stored fit, else one rate for all and even roots."""
    if o.params:
        return stores.load_params(o.params)
    q = np.full((o.states, o.states), o.rate / (o.states - 1))
    np.fill_diagonal(q, -o.rate)
    return q, np.full(o.states, 1.0 / o.states)


def _told(spark: SparkSession, o: argparse.Namespace, pi: np.ndarray) -> DataFrame:
    """(node, time, e) from nodes (node, time) and labels (node, label, w)."""
    nodes = spark.read.parquet(o.nodes)
    who = [c for c in ("member",) if c in nodes.columns]
    rows = nodes.select(*who, "node", "time").join(spark.read.parquet(o.labels), "node", "left")
    rows = rows if "w" in rows.columns else rows.withColumn("w", F.lit(1.0))
    even = F.array(*[F.lit(1.0)] * len(pi))
    return rows.select(*who, "node", "time", F.when(F.col("label").isNotNull() | (F.col("time") == 0), weave.emissions(rows, pi)).otherwise(even).alias("e"))


def _samples(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return spark.read.parquet(o.nodes).where("time = 0").select(F.col("node").alias("sample")).distinct()


def _paint(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    q, pi = _start(o)
    masks = spark.read.parquet(o.masks) if o.masks else None
    return weave.paint(spark.read.parquet(o.edges), _told(spark, o, pi), _samples(spark, o), q, pi, o.length, o.width, o.leave_one_out, masks=masks, smoothing=o.smoothing)


def _windows(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    q, pi = _start(o)
    return paint_windows(spark.read.parquet(o.edges), _told(spark, o, pi), _samples(spark, o), q, pi, o.length, o.size or o.length, o.folder).painting()


def _panel(spark: SparkSession, o: argparse.Namespace) -> painters.Panel:
    q, pi = _start(o)
    return painters.Panel(spark.read.parquet(o.edges), spark.read.parquet(o.nodes), spark.read.parquet(o.labels), _samples(spark, o), q, pi, o.length, o.width)


def _nearest(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return painters.PAINTERS["nearest"](_panel(spark, o))


def _compare(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return painters.head_to_head(_panel(spark, o), spark.read.parquet(o.truth))


def _detect(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    p = _panel(spark, o)
    depths = nearest.depths(p.edges, p.nodes, p.references, p.samples, o.length, o.width)
    return ghosts.detect(depths, p.references, o.width, o.by, o.iterations).posteriors


def _genotypes(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return mutations.genotypes(spark.read.parquet(o.edges), spark.read.parquet(o.nodes), spark.read.parquet(o.mutations), _samples(spark, o))


def _variants(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return arrays.read_variants(spark, o.source, spark.read.parquet(o.sex) if o.sex else None)


def _fit(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    q, pi = _start(o)
    q, pi, history = weave.fit(spark.read.parquet(o.edges), lambda now: _told(spark, o, now), q, pi, o.width, o.iterations)
    return stores.params_table(spark, q, pi, history)


def _date(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    q, pi = _start(o)
    nodes = _told(spark, o, pi)
    return dating.rate_through_time(spark.read.parquet(o.edges), nodes, q, pi, dating.grid(nodes, o.cells), o.width, o.iterations).table(spark)


def _audit(spark: SparkSession, o: argparse.Namespace) -> references.Audit:
    q, pi = _start(o)
    return references.audit(spark.read.parquet(o.edges), spark.read.parquet(o.nodes), spark.read.parquet(o.labels), q, pi, o.length, o.width, iterations=o.iterations)


def _qc(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return _audit(spark, o).summary(_states(o), o.length, o.deadband)


def _introgress(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return references.foreign_tracts(spark.read.parquet(o.tracks), spark.read.parquet(o.labels), _states(o), o.least_score, width=o.width)


def _aggregate(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return metrics.aggregate(spark.read.parquet(o.scores))


def _merge(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return intervals.merge_members(spark.read.parquet(o.tracks), ["sample"], "member", _states(o), o.width)


def _segments(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return hard_segments(spark.read.parquet(o.tracks), _states(o), o.deadband)


def _smooth(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return chains.smooth(spark.read.parquet(o.tracks), o.epsilon, o.width, tuple([1.0 / o.states] * o.states))


def _score(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    tracks = spark.read.parquet(o.tracks)
    both = intervals.overlap_join(tracks, spark.read.parquet(o.truth), ["sample"], o.width)
    out = metrics.per_base_accuracy(both, _states(o))
    for more in (metrics.balanced_accuracy(both, _states(o)), metrics.mean_confidence(tracks, _states(o)), metrics.flicker(tracks, _states(o))):  # one row each
        out = out.join(F.broadcast(more))
    return out


def _ghost(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return chains.ghost_fit(spark.read.parquet(o.depths), (o.mu, o.sd), o.floor, o.width, o.iterations)


COMMANDS = {
    "paint": (_paint, ["edges", "nodes", "labels"]),
    "fit": (_fit, ["edges", "nodes", "labels"]),
    "date": (_date, ["edges", "nodes", "labels"]),
    "qc": (_qc, ["edges", "nodes", "labels"]),
    "introgress": (_introgress, ["tracks", "labels"]),
    "aggregate": (_aggregate, ["scores"]),
    "merge": (_merge, ["tracks"]),
    "segments": (_segments, ["tracks"]),
    "smooth": (_smooth, ["tracks"]),
    "score": (_score, ["tracks", "truth"]),
    "ghost": (_ghost, ["depths"]),
    "windows": (_windows, ["edges", "nodes", "labels", "folder"]),
    "nearest": (_nearest, ["edges", "nodes", "labels"]),
    "compare": (_compare, ["edges", "nodes", "labels", "truth"]),
    "detect": (_detect, ["edges", "nodes", "labels"]),
    "genotypes": (_genotypes, ["edges", "nodes", "mutations"]),
    "variants": (_variants, ["source"]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lociflow", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, inputs) in COMMANDS.items():
        one = commands.add_parser(name)
        for table in inputs:
            one.add_argument(f"--{table}", required=True)
        one.add_argument("--out", required=True)
        for number, default in (("rate", 1e-3), ("least-score", 0.5), ("length", 1.0), ("width", 1e5), ("deadband", 0.0), ("epsilon", 1e-3), ("mu", 0.0), ("sd", 1.0), ("floor", 1.0), ("smoothing", 0.0), ("size", 0.0)):
            one.add_argument(f"--{number}", type=float, default=default)
        one.add_argument("--states", type=int, default=2)
        one.add_argument("--cells", type=int, default=40)
        one.add_argument("--iterations", type=int, default=50)
        one.add_argument("--by", default="time", choices=["time", "rank"])
        one.add_argument("--masks", help="stretches (node, left, right) where a reference says nothing")
        one.add_argument("--sex", help="(name, sex) of individuals, where the calls are of a sex chromosome")
        one.add_argument("--params", help="a stored fit to start from")
        one.add_argument("--leave-one-out", action="store_true")
    return top


def main(args: list[str] | None = None) -> None:
    o = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"lociflow {o.command}").getOrCreate()
    COMMANDS[o.command][0](spark, o).write.mode("overwrite").parquet(o.out)


if __name__ == "__main__":
    main()
