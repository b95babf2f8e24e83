"""Rates through time: time grids, Poisson P-splines on the logarithm of time, and split times. Small arrays, for the driver."""

from __future__ import annotations

import numpy as np


def time_grid(low: float, high: float, cells: int) -> np.ndarray:
    return np.geomspace(low, high, cells + 1)


def cell_centers(edges: np.ndarray) -> np.ndarray:
    return np.sqrt(edges[:-1] * edges[1:])


def split_branch(child: float, parent: float, edges: np.ndarray) -> np.ndarray:
    """Time that a branch spends in each cell; beyond the grid it counts in the outer cells, so the sum is the branch."""
    low, high = edges[:-1].copy(), edges[1:].copy()
    low[0], high[-1] = -np.inf, np.inf
    return np.maximum(0.0, np.minimum(parent, high) - np.maximum(child, low))


def basis(x: np.ndarray, inner: int, degree: int = 3) -> np.ndarray:
    """B-splines by the recurrence over degrees; inner points evenly from min to max, the ends repeated."""
    points = np.linspace(x.min(), x.max(), inner)
    knots = np.concatenate([np.full(degree, points[0]), points, np.full(degree, points[-1])])
    out = ((x[:, None] >= knots[:-1]) & (x[:, None] < knots[1:])).astype(float)
    out[x >= points[-1], np.flatnonzero(np.diff(knots) > 0)[-1]] = 1.0
    for d in range(1, degree + 1):
        n = len(knots) - d - 1
        gap_a, gap_b = knots[d : d + n] - knots[:n], knots[d + 1 : d + 1 + n] - knots[1 : 1 + n]
        a = np.where(gap_a > 0, (x[:, None] - knots[:n]) / np.where(gap_a > 0, gap_a, 1), 0)
        b = np.where(gap_b > 0, (knots[d + 1 : d + 1 + n] - x[:, None]) / np.where(gap_b > 0, gap_b, 1), 0)
        out = a * out[:, :n] + b * out[:, 1 : n + 1]
    return out


#: Points of the basis, the weights tried, and where exponents end.
INNER, WEIGHTS, FURTHEST = 25, np.geomspace(1e-2, 1e4, 18), 30.0


def poisson_splines(centers: np.ndarray, events: np.ndarray, exposure: np.ndarray, weights: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates[weight, cell], deviance[weight], effective parameters[weight]) of Poisson fits whose second differences are penalised, one for each weight.

    All fits climb together by Newton's method: a batch of gradients and curvatures and one batched solve a step, until no gradient is left to speak of.
    The splines span all cells; cells without exposure only get rates.
    """
    every, told = basis(np.log(centers), inner), np.flatnonzero(exposure > 0)
    b, y, t = every[told], events[told], exposure[told]
    bends = np.diff(np.eye(b.shape[1]), n=2, axis=0)
    penalty = np.asarray(weights, float)[:, None, None] * (bends.T @ bends)
    level = np.log(y.sum() / t.sum()) if y.sum() > 0 else 0.0
    coef = np.full((len(penalty), b.shape[1]), level)

    def expected() -> np.ndarray:
        return np.maximum(t * np.exp(np.clip(coef @ b.T, -FURTHEST, FURTHEST)), 1e-12)

    def curvature(mean: np.ndarray) -> np.ndarray:
        return np.einsum("ci,wc,cj->wij", b, mean, b, optimize=True)

    enough = 1e-9 * (1.0 + y.sum())
    for _ in range(60):
        mean = expected()
        gradient = (y - mean) @ b - np.einsum("wij,wj->wi", penalty, coef)
        if np.abs(gradient).max(initial=0.0) < enough:
            break
        coef = coef + np.linalg.solve(curvature(mean) + penalty, gradient[:, :, None])[:, :, 0]
    mean = expected()
    gain = np.where(y > 0, y, 1.0) * np.log(np.where(y > 0, y, 1.0) / mean)
    deviance = 2.0 * (np.where(y > 0, gain, 0.0) - (y - mean)).sum(axis=1)
    fisher = curvature(mean)
    parameters = np.einsum("wii->w", np.linalg.solve(fisher + penalty, fisher))
    return np.exp(np.clip(coef @ every.T, -FURTHEST, FURTHEST)), deviance, parameters


def poisson_spline(centers: np.ndarray, events: np.ndarray, exposure: np.ndarray, smoothing: float, inner: int = INNER) -> tuple[np.ndarray, float, float]:
    """(rates, deviance, effective parameters) of the fit with one weight."""
    rates, deviance, parameters = poisson_splines(centers, events, exposure, np.array([smoothing]), inner)
    return rates[0], float(deviance[0]), float(parameters[0])


def best_spline(centers: np.ndarray, events: np.ndarray, exposure: np.ndarray) -> tuple[np.ndarray, float]:
    """(rates, weight) with the least generalised cross-validation; fits with hardly a cell more than parameters don't count."""
    rates, deviance, parameters = poisson_splines(centers, events, exposure, WEIGHTS)
    spare = np.count_nonzero(exposure > 0) - parameters
    with np.errstate(divide="ignore"):
        score = np.where(spare > 1, (spare + parameters) * deviance / spare**2, np.inf)
    chosen = int(score.argmin())
    return rates[chosen], float(WEIGHTS[chosen])


def split_time(centers: np.ndarray, rates: np.ndarray, exposure: np.ndarray, least_share: float = 0.01) -> float | None:
    """The youngest cell that lies on the old side of the middle between the least and the greatest rate; the old side is the upper one where the oldest
    quarter of the cells has a mean no lower than the youngest quarter's. Cells under a share of the largest exposure don't count; without two cells or any change
    there is no split."""
    told = np.isfinite(rates) & (exposure >= least_share * np.nanmax(exposure, initial=0.0))
    rate = rates[told]
    if np.count_nonzero(told) < 2 or np.ptp(rate) == 0 or rate.max() <= 0:
        return None
    ends = np.split(rate, [max(1, len(rate) // 4), len(rate) - max(1, len(rate) // 4)]) if len(rate) > 1 else [rate] * 3
    side = 1.0 if ends[2].mean() >= ends[0].mean() else -1.0
    above = side * (rate - (rate.min() + rate.max()) / 2) >= 0
    return float(centers[told][above.argmax()])


def split_times(centers: np.ndarray, dwell: np.ndarray, jumps: np.ndarray, least_share: float = 0.01) -> dict[tuple[int, int], float | None]:
    """The split time of each unordered pair of states, from both directions' rates and both states' exposure.

    dwell: cells by states; jumps: cells by states by states."""
    q = np.divide(jumps, dwell[:, :, None], out=np.zeros_like(jumps, dtype=float), where=dwell[:, :, None] > 0)
    both = q + q.transpose(0, 2, 1)
    return {(int(m), int(n)): split_time(centers, both[:, m, n], dwell[:, m] + dwell[:, n], least_share) for m, n in np.transpose(np.triu_indices(dwell.shape[1], 1))}
