"""Result stores: fitted parameters, rate profiles, audits and ghost fits as parquet, sample identifiers and labels, and JSON label files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def params_table(spark: SparkSession, q: np.ndarray, pi: np.ndarray, history: list[float] | None = None) -> DataFrame:
    """One row: q (row by row), pi and the log-likelihoods of a fit."""
    return spark.createDataFrame([(np.asarray(q, float).ravel().tolist(), np.asarray(pi, float).tolist(), [float(x) for x in history or []])], "q array<double>, pi array<double>, loglik array<double>")


def load_params(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(q, pi) of a stored fit."""
    r = SparkSession.active().read.parquet(path).select("q", "pi").first()
    k = len(r.pi)
    return np.reshape(np.array(r.q, float), (k, k)), np.array(r.pi, float)


def save_rates(profile, spark: SparkSession, path: str) -> None:
    profile.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_rates(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(centers, q, dwell, jumps) of a stored profile."""
    rows = spark.read.parquet(path).orderBy("cell", "source", "target").collect()  # a row a cell and pair of states
    cells, k = 1 + max(r.cell for r in rows), 1 + max(max(r.source, r.target) for r in rows)
    centers, q, dwell, jumps = np.zeros(cells), np.zeros((cells, k, k)), np.zeros((cells, k)), np.zeros((cells, k, k))
    for r in rows:
        centers[r.cell], q[r.cell, r.source, r.target], dwell[r.cell, r.source], jumps[r.cell, r.source, r.target] = r.center, r.rate, r.exposure, r.events
    return centers, q, dwell, jumps


def save_audit(found, path: str) -> None:
    """An audit as two tables beside each other and its generator."""
    found.credibility.write.mode("overwrite").parquet(f"{path}/credibility")
    found.tracks.write.mode("overwrite").parquet(f"{path}/tracks")
    params_table(found.tracks.sparkSession, found.q, np.zeros(len(found.q))).write.mode("overwrite").parquet(f"{path}/params")


def load_audit(spark: SparkSession, path: str):
    from lociflow.operators.references import Audit

    return Audit(spark.read.parquet(f"{path}/credibility"), spark.read.parquet(f"{path}/tracks"), load_params(f"{path}/params")[0])


def save_ghosts(found, path: str) -> None:
    """What ghosts.detect finds: its posteriors, and one row with the law and the anchor it was fitted from."""
    found.posteriors.write.mode("overwrite").parquet(f"{path}/posteriors")
    a = found.anchor
    law = [(a.mean, a.deviation, a.deepest, a.floor, a.scale, found.mean, found.deviation, found.transition.ravel().tolist(), found.start.tolist(), list(map(float, found.history)))]
    kinds = "known_mean double, known_deviation double, deepest double, floor double, scale double, mean double, deviation double, transition array<double>, start array<double>, loglik array<double>"
    found.posteriors.sparkSession.createDataFrame([tuple(float(x) if isinstance(x, (int, float, np.floating)) else x for x in law[0])], kinds).write.mode("overwrite").parquet(f"{path}/law")


def load_ghosts(spark: SparkSession, path: str):
    from lociflow.operators.ghosts import Anchor, Ghosts

    r = spark.read.parquet(f"{path}/law").first()
    anchor = Anchor(r.known_mean, r.known_deviation, r.deepest, r.floor, r.scale)
    return Ghosts(spark.read.parquet(f"{path}/posteriors"), anchor, r.mean, r.deviation, np.reshape(r.transition, (2, 2)), np.array(r.start), list(r.loglik))


def save_tracts(tracts: DataFrame, path: str) -> None:
    """Tracts (sample or node, left, right, ...) as one table."""
    tracts.write.mode("overwrite").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of JSON files that hold one object of identifiers and labels each; labels as text."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), T.StringType())).alias("m"))
    return text.select(F.explode("m").alias("id", "label"))


def write_labels(labels: DataFrame, path: str) -> None:
    """(id, label) as one JSON object; labels are few: a reference panel."""
    one = labels.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), F.col("label").cast("string"))))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): one identifier a line; blank lines and those that begin with # don't count, repeats count once."""
    lines = spark.read.text(path).select(F.trim("value").alias("id"))
    return lines.where((F.col("id") != "") & ~F.startswith("id", F.lit("#"))).distinct()


def named_states(labels: DataFrame, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, state), (state, name)) of labels (id, label): states number the names in order of their text; there are few names."""
    from lociflow.operators.order import numbered

    names = numbered(labels.select(F.col("label").alias("name")).distinct(), "name", "state")
    return labels.join(F.broadcast(names), F.col("label") == F.col("name")).select("id", "state"), names


def resolve(wanted: DataFrame, samples: DataFrame) -> DataFrame:
    """(id, node) of the wanted ids (id): haplotypes by their own name or number, individuals by theirs, which gives all their haplotypes.

    samples: (node, haplotype, individual). Unknown ids have a null node; an id is looked up as a haplotype first.
    """
    by_name = samples.select(F.col("haplotype").alias("__k"), "node").where("__k IS NOT NULL")
    by_number = samples.select(F.col("node").cast("string").alias("__k"), "node")
    own = by_name.unionByName(by_number).distinct()
    first = wanted.select("id").distinct().join(own, F.col("id") == F.col("__k"), "left").drop("__k")
    known = first.where("node IS NOT NULL")
    rest = first.where("node IS NULL").select("id")
    more = rest.join(samples.select(F.col("individual").alias("__k"), "node").where("__k IS NOT NULL").distinct(), F.col("id") == F.col("__k"), "left").drop("__k")
    return known.unionByName(more)
