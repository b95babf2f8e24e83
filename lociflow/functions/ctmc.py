"""Two-state continuous-time chains as column expressions, and small K-state arrays for the driver.

Rates a (0 to 1) and b (1 to 0); with s = a + b, every row of A is the stationary distribution (b, a) / s, B = I - A and
P(t) = A + exp(-s t) B. The integral of P(u) E P(t - u) over a branch is
t AEA + (1 - exp(-s t)) / s (AEB + BEA) + t exp(-s t) BEB.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def generator(a: float, b: float) -> np.ndarray:
    return np.array([[-a, a], [b, -b]])


def symmetric_generator(k: int, rate: float) -> np.ndarray:
    q = np.full((k, k), rate / (k - 1))
    np.fill_diagonal(q, -rate)
    return q


def stationary(q: np.ndarray) -> np.ndarray:
    """The probability vector that the generator leaves as it is."""
    k = len(q)
    lhs = np.vstack([q.T, np.ones(k)])
    return np.linalg.lstsq(lhs, np.append(np.zeros(k), 1.0), rcond=None)[0]


def expm(m: np.ndarray) -> np.ndarray:
    """exp(m) by a Taylor series of the scaled matrix, squared back."""
    power = max(0, int(np.ceil(np.log2(max(np.abs(m).sum(axis=1).max(), 1e-300)))) + 4)
    x, term, out = m / 2.0**power, np.eye(len(m)), np.eye(len(m))
    for k in range(1, 18):
        term = term @ x / k
        out = out + term
    for _ in range(power):
        out = out @ out
    return out


def transition(q: np.ndarray, t: float) -> np.ndarray:
    return expm(q * t)


def reward_integral(q: np.ndarray, e: np.ndarray, t: float) -> np.ndarray:
    """The integral of P(u) E P(t - u) for u from 0 to t: the upper right block of exp of a block matrix."""
    k = len(q)
    block = np.block([[q, e], [np.zeros((k, k)), q]])
    return expm(block * t)[:k, k:]


def branch_statistics(q: np.ndarray, t: float, xi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dwell[k], jumps[k, k]) expected on a branch of length t whose end states have the joint distribution xi; zeros for t <= 0."""
    k = len(q)
    dwell, jumps = np.zeros(k), np.zeros((k, k))
    if t <= 0:
        return dwell, jumps
    weight = xi / np.maximum(transition(q, t), 1e-300)
    for m in range(k):
        for n in range(k):
            unit = np.zeros((k, k))
            unit[m, n] = 1.0
            value = float((reward_integral(q, unit, t) * weight).sum())
            if m == n:
                dwell[m] = value
            else:
                jumps[m, n] = q[m, n] * value
    return dwell, jumps


def _parts(a: float, b: float) -> tuple[float, np.ndarray, np.ndarray]:
    s = a + b
    big = np.array([[b, a], [b, a]]) / s
    return s, big, np.eye(2) - big


def transition_columns(a: float, b: float, t: Column) -> list[list[Column]]:
    """P(t) of the two-state chain as columns."""
    s, big, rest = _parts(a, b)
    decay = F.exp(-F.lit(s) * t)
    return [[F.lit(float(big[i, j])) + F.lit(float(rest[i, j])) * decay for j in range(2)] for i in range(2)]


def reward_columns(a: float, b: float, t: Column, m: int, n: int) -> list[list[Column]]:
    """The reward integral for E = the unit matrix at (m, n) as columns."""
    s, big, rest = _parts(a, b)
    unit = np.zeros((2, 2))
    unit[m, n] = 1.0
    aea, mixed, beb = big @ unit @ big, big @ unit @ rest + rest @ unit @ big, rest @ unit @ rest
    one = -F.expm1(-F.lit(s) * t) / F.lit(s)
    last = t * F.exp(-F.lit(s) * t)
    return [[F.lit(float(aea[i, j])) * t + F.lit(float(mixed[i, j])) * one + F.lit(float(beb[i, j])) * last for j in range(2)] for i in range(2)]


def m_step_rates(dwell: np.ndarray, jumps: np.ndarray) -> np.ndarray:
    """Rates jumps / dwell (0 where nothing dwells) as a generator."""
    q = np.where(dwell[:, None] > 0, jumps / np.where(dwell > 0, dwell, 1)[:, None], 0.0)
    np.fill_diagonal(q, 0.0)
    np.fill_diagonal(q, -q.sum(axis=1))
    return q


def m_step_root(root: np.ndarray) -> np.ndarray:
    total = root.sum()
    return root / total if total > 0 else np.full(len(root), 1.0 / len(root))


def m_step_credibility(agree: float, disagree: float, alpha: float = 20.0, beta: float = 1.0) -> float:
    """The mode of a Beta posterior."""
    return (alpha - 1 + agree) / (alpha + beta - 2 + agree + disagree)
