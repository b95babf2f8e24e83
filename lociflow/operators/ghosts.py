"""Ancestry from a source that the panel lacks, found by how deep samples meet their nearest reference.

Depths (from nearest.depths) become observations, logarithms or their length-weighted ranks. The references' own depths fix the law of the known
state and a floor below which nothing counts as unsampled. A hidden Markov model of the two states is fitted on all samples, and
all members of an ensemble, together; each is decoded on its own, and members are averaged. No depth says nothing.

Equal depths count as one in the quantile, which is interpolated between different depths. Without any reference's depth there is no
anchor, which is an error. Empty samples give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.cluster import Stored
from lociflow.operators import chains, order
from lociflow.operators import intervals as iv

_KEY = ["member", "sample"]


@dataclass
class Anchor:
    """The known state's mean and deviation, the deepest a reference goes, and the unsampled state's floor and scale."""

    mean: float
    deviation: float
    deepest: float
    floor: float
    scale: float


@dataclass
class Ghosts:
    """posteriors: (sample, left, right, p0, p1, status), p1 the unsampled state's; parameters of the last step; log-likelihoods."""

    posteriors: DataFrame
    anchor: Anchor
    mean: float
    deviation: float
    transition: np.ndarray
    start: np.ndarray
    history: list[float]

    def burden(self) -> DataFrame:
        return chains.burden(self.posteriors)

    def tracts(self, threshold: float = 0.5, width: float | None = None) -> DataFrame:
        return chains.ghost_tracts(self.posteriors, threshold, width)


def _bin(rows: DataFrame, value: str) -> float:
    low, high = rows.agg(F.min(value), F.max(value)).first()
    return max((high - low) / 1000, 1e-9) if low is not None else 1.0


def observations(depths: DataFrame, by: str = "time") -> DataFrame:
    """depths (member, sample, left, right, depth) with x: ln of the depth (null at 0 or below), or its rank within the member by length."""
    if by == "time":
        return depths.withColumn("x", F.when(F.col("depth") > 0, F.ln("depth")))
    if by != "rank":
        raise ValueError("by is time or rank")
    rows = depths.withColumn("__w", F.col("right") - F.col("left"))
    return order.cumulative_share(rows, ["member"], "depth", "__w", _bin(rows, "depth")).withColumnRenamed("share", "x").drop("__w")


def anchor(references: DataFrame, by: str = "time", quantile: float = 0.98, delta: float | None = None) -> Anchor:
    """From the references' observations (left, right, x)."""
    rows = references.where("x IS NOT NULL").select("x", (F.col("right") - F.col("left")).alias("w"))
    mean = F.sum(F.col("w") * F.col("x")) / F.sum("w")
    m = rows.agg(mean.alias("m")).first().m
    if m is None:
        raise ValueError("no reference meets another, so there is no depth to compare with")
    v = rows.agg(F.sum(F.col("w") * (F.col("x") - m) ** 2) / F.sum("w")).first()[0]
    share = order.cumulative_share(rows, [], "x", "w", _bin(rows, "x"))
    below, reached = F.col("share") < quantile, F.col("share") >= quantile
    s = share.agg(F.max(F.when(below, F.struct("x", "share"))).alias("a"), F.min(F.when(reached, F.struct("x", "share"))).alias("b")).first()
    deepest = s.b.x if s.a is None else s.a.x + (quantile - s.a.share) / (s.b.share - s.a.share) * (s.b.x - s.a.x)
    deviation = max(1e-3, float(np.sqrt(v)), (deepest - m) / 2)
    if by == "rank":
        half = max(1 - deepest, 1e-3) / 2  # half the room above the references
        return Anchor(m, deviation, deepest, deepest + (half if delta is None else min(delta, half)), half)
    return Anchor(m, deviation, deepest, deepest + (deviation if delta is None else delta), deviation)


def detect(depths: DataFrame, references: DataFrame, width: float, by: str = "time", iterations: int = 50, tolerance: float = 1e-3, delta: float | None = None, burden: float = 0.1, switch: float = 0.02) -> Ghosts:
    """depths: (member, sample, left, right, depth) of references and samples, as nearest.depths gives them; references: (node); all other samples are searched."""
    rows = Stored(observations(depths, by).select(*_KEY, "left", "right", "x"), "observations")
    refs = references.select(F.col("node").alias("sample")).distinct()
    known = anchor(rows.df.join(refs, "sample", "left_semi"), by, delta=delta)
    searched = rows.df.join(refs, "sample", "left_anti").withColumnRenamed("x", "depth")
    law = chains.fitted(searched, (known.mean, known.deviation), known.floor, width, iterations, tolerance, known.scale, burden, switch, _KEY)
    e = chains.gaussian_emissions(searched, (known.mean, law.mean), (known.deviation, law.deviation))
    got = chains.forward_backward(e, _KEY, law.transition, law.start, width).select(*_KEY, "left", F.col("g0").alias("p0"), F.col("g1").alias("p1"))
    decoded = searched.join(got, [*_KEY, "left"]).select(*_KEY, "left", "right", "p0", "p1", F.when(F.col("depth").isNull(), "missing-info").otherwise("informative").alias("status"))
    decoded = Stored(decoded, "ghosts").df
    if decoded.agg(F.min("member") < F.max("member")).first()[0]:
        decoded = iv.merge_members(decoded, ["sample"], "member", ["p0", "p1"], width)
    else:
        decoded = decoded.drop("member")
    return Ghosts(decoded, known, law.mean, law.deviation, law.transition, law.start, law.history)
