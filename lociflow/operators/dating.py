"""Rates between states through time: expectation-maximisation over a time grid, splines in the M-step, split times.

The E-step is weave.posteriors under a generator for each cell and what branches then do in each cell; as many numbers as the grid
has cells reach the driver, where the splines are fitted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions import splines
from lociflow.operators import weave


@dataclass
class Profile:
    """Rates q[cell, from, to] at the cells' centers, with the dwell and jumps they come from and each pass's log-likelihood."""

    centers: np.ndarray
    q: np.ndarray
    dwell: np.ndarray
    jumps: np.ndarray
    history: list[float]

    def split_times(self, least_share: float = 0.01) -> dict[tuple[int, int], float | None]:
        with np.errstate(invalid="ignore"):
            both = {(m, n): (self.q[:, m, n] + self.q[:, n, m], self.dwell[:, m] + self.dwell[:, n]) for m in range(self.q.shape[1]) for n in range(m + 1, self.q.shape[1])}
        return {pair: splines.split_time(self.centers, rate, exposure, least_share) for pair, (rate, exposure) in both.items()}

    def table(self, spark) -> DataFrame:
        """(cell, center, source, target, rate, exposure, events): one row a cell and ordered pair of states."""
        k = self.q.shape[1]
        rows = [(c, float(self.centers[c]), m, n, float(self.q[c, m, n]), float(self.dwell[c, m]), float(self.jumps[c, m, n])) for c in range(len(self.centers)) for m in range(k) for n in range(k) if m != n]
        return spark.createDataFrame(rows, "cell int, center double, source int, target int, rate double, exposure double, events double")


def grid(nodes: DataFrame, cells: int = 40) -> np.ndarray:
    """Edges of cells even in log time, from the youngest node above 0 (1 at least) to a little beyond the oldest."""
    low, high = nodes.where("time > 0").agg(F.min("time"), F.max("time")).first()
    return splines.time_grid(max(1.0, low or 1.0), 1.05 * max(high or 1.0, 1.0 + 1e-9), cells)


def rate_through_time(edges: DataFrame, nodes: DataFrame, q: np.ndarray, pi: np.ndarray, times: np.ndarray, width: float, iterations: int = 15, tolerance: float = 1e-4, floor: float = 1e-9) -> Profile:
    """Fit directional rates through time, from a constant generator q; nodes carry their emissions, pi stays as it is."""
    cells, k = len(times) - 1, len(q)
    centers = splines.cell_centers(times)
    now = np.tile(np.maximum(np.asarray(q, float), floor), (cells, 1, 1))
    history: list[float] = []
    dwell, jumps = np.zeros((cells, k)), np.zeros((cells, k, k))
    for it in range(iterations):
        rates = weave.ByCell(generators(now), times)
        sums = weave.expected(edges, nodes, rates, pi)
        roots = weave.part(sums, "roots", False)
        for r in weave.cell_statistics(weave.part(sums, "branches", False), rates).collect():  # a row a cell
            dwell[r.cell], jumps[r.cell] = r.dwell, np.reshape(r.jumps, (k, k))
        whole = roots.agg(F.sum(F.col("loglik") * (F.col("right") - F.col("left")))).first()[0]
        sums.drop()
        if whole is None:
            break
        history.append(whole)
        now = np.zeros_like(now)
        for m in range(k):
            for n in range(k):
                if m != n:
                    fitted = splines.best_spline(centers, jumps[:, m, n], dwell[:, m])[0] if (dwell[:, m] > 0).any() else np.full(cells, floor)
                    now[:, m, n] = np.maximum(np.nan_to_num(fitted, nan=floor), floor)
        if it > 0 and abs(history[-1] - history[-2]) < tolerance * (abs(history[-2]) + 1e-12):
            break
    now[:, np.arange(k), np.arange(k)] = 0.0
    return Profile(centers, now, dwell, jumps, history)


def generators(rates: np.ndarray) -> np.ndarray:
    """Rates off the diagonal with the diagonal that makes rows sum to zero."""
    out = np.array(rates, float)
    k = np.arange(out.shape[1])
    out[:, k, k] = 0.0
    out[:, k, k] = -out.sum(axis=2)
    return out
