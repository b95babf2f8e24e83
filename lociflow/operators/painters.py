"""Painters by name, all from the same panel to tracks, and how they compare against one truth."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.cluster import Stored
from lociflow.operators import intervals as iv
from lociflow.operators import metrics, nearest, weave


@dataclass
class Panel:
    """edges (left, right, parent, child), nodes (node, time), references (node, label), samples (sample), and the law that painters go by."""

    edges: DataFrame
    nodes: DataFrame
    references: DataFrame
    samples: DataFrame
    q: np.ndarray
    pi: np.ndarray
    length: float
    width: float
    trust: float = 1.0
    switch: float = 0.01

    @property
    def states(self) -> list[str]:
        return [f"p{s}" for s in range(len(self.pi))]

    def told(self) -> DataFrame:
        """nodes with emissions: references by their label and the trust in it, other nodes at time 0 as pi, older ones nothing."""
        rows = self.nodes.join(self.references.select("node", "label"), "node", "left").withColumn("w", F.lit(float(self.trust)))
        even = F.array(*[F.lit(1.0)] * len(self.pi))
        return rows.select(*[c for c in ("member",) if c in rows.columns], "node", "time", F.when(F.col("label").isNotNull() | (F.col("time") == 0), weave.emissions(rows, self.pi)).otherwise(even).alias("e"))


PAINTERS: dict[str, Callable[[Panel], DataFrame]] = {}


def painter(name: str):
    """Register a function from a panel to tracks under a name."""

    def add(f: Callable[[Panel], DataFrame]) -> Callable[[Panel], DataFrame]:
        PAINTERS[name] = f
        return f

    return add


@painter("posterior")
def _posterior(p: Panel) -> DataFrame:
    return weave.paint(p.edges, p.told(), p.samples, p.q, p.pi, p.length, p.width)


@painter("smoothed")
def _smoothed(p: Panel) -> DataFrame:
    return weave.paint(p.edges, p.told(), p.samples, p.q, p.pi, p.length, p.width, smoothing=p.switch)


@painter("nearest")
def _nearest(p: Panel) -> DataFrame:
    return nearest.paint(p.edges, p.nodes, p.references, p.samples, len(p.pi), p.length, p.width)


def head_to_head(panel: Panel, truth: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(painter, metric, value) of the named painters, of all where none are: accuracy, balanced_accuracy, confidence and switches a sample. truth: (sample, left, right, state).

    A name that no painter has is an error.
    """
    found = None
    for name in names or sorted(PAINTERS):
        tracks = Stored(PAINTERS[name](panel), "painted").df
        both = iv.overlap_join(tracks, truth, ["sample"], panel.width)
        top = tracks.withColumn("state", metrics.top(panel.states))
        changes = iv.switches(top, ["sample"], "state", panel.width).agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(panel.samples.agg(F.count_distinct("sample").alias("n"))))  # one row each
        parts = [
            (metrics.per_base_accuracy(both, panel.states), "accuracy", F.col("accuracy")),
            (metrics.balanced_accuracy(both, panel.states), "balanced_accuracy", F.col("balanced_accuracy")),
            (metrics.mean_confidence(tracks, panel.states), "confidence", F.col("confidence")),
            (changes, "switches", F.try_divide("c", "n")),
        ]
        for rows, metric, value in parts:
            one = rows.select(F.lit(name).alias("painter"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
            found = one if found is None else found.unionByName(one)
    return found
