import itertools

import numpy as np
import pytest

from lociflow.functions import ctmc, splines
from lociflow.operators import chains, pruning

A, B, PI = 0.3, 0.7, (0.6, 0.4)


def test_transition_and_rewards():
    q = ctmc.generator(A, B)
    p = ctmc.transition(q, 1.7)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(ctmc.stationary(q) @ p, ctmc.stationary(q))
    steps = np.linspace(0, 1.7, 4001)
    unit = np.array([[0, 1.0], [0, 0]])
    grid = np.array([ctmc.transition(q, u) @ unit @ ctmc.transition(q, 1.7 - u) for u in steps[::40]])
    assert np.allclose(np.trapezoid(grid, steps[::40], axis=0), ctmc.reward_integral(q, unit, 1.7), atol=1e-4)


@pytest.mark.parametrize("t", [0.4, 2.3, 5.0])
def test_dwell_times_sum_to_the_branch(t):
    q = ctmc.symmetric_generator(3, 0.8)
    xi = ctmc.stationary(q)[:, None] * ctmc.transition(q, t)
    dwell, jumps = ctmc.branch_statistics(q, t, xi)
    assert np.isclose(dwell.sum(), t) and np.allclose(np.diag(jumps), 0)
    assert ctmc.branch_statistics(q, 0.0, xi)[0].sum() == 0


def test_columns_equal_arrays(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.5,), (3.0,)], "t double")
    p, v = ctmc.transition_columns(A, B, F.col("t")), ctmc.reward_columns(A, B, F.col("t"), 0, 1)
    unit = np.array([[0, 1.0], [0, 0]])
    for r in df.select("t", *[p[i][j].alias(f"p{i}{j}") for i in range(2) for j in range(2)], *[v[i][j].alias(f"v{i}{j}") for i in range(2) for j in range(2)]).collect():
        assert np.allclose([[r.p00, r.p01], [r.p10, r.p11]], ctmc.transition(ctmc.generator(A, B), r.t))
        assert np.allclose([[r.v00, r.v01], [r.v10, r.v11]], ctmc.reward_integral(ctmc.generator(A, B), unit, r.t))


def forest(spark):
    rows = [("a", "x", 0.0, 0, 1, 0.8), ("b", "x", 0.0, 0, None, None), ("c", "y", 0.0, 0, 0, 1.0), ("x", "r", 1.0, 1, None, None), ("y", "r", 1.0, 1, None, None), ("r", None, 2.5, 2, None, None)]
    return spark.createDataFrame(rows, "node string, parent string, time double, level int, label int, w double")


def test_pruning_equals_enumeration(spark):
    q = ctmc.generator(A, B)
    e = {r.node: (r.e0, r.e1) for r in pruning.emissions(forest(spark), PI).collect()}
    nodes, parent, t = list("abcxyr"), dict(zip("abcxy", "xxyrr", strict=True)), dict(zip("abcxy", (1.0, 1.0, 1.0, 1.5, 1.5), strict=True))
    post, total = {n: np.zeros(2) for n in nodes}, 0.0
    for states in itertools.product((0, 1), repeat=6):
        s = dict(zip(nodes, states, strict=True))
        w = PI[s["r"]] * np.prod([e[n][s[n]] for n in nodes]) * np.prod([ctmc.transition(q, t[n])[s[parent[n]], s[n]] for n in parent])
        total += w
        for n in nodes:
            post[n][s[n]] += w
    got = {r.node: r for r in pruning.prune(pruning.emissions(forest(spark), PI), A, B, PI, 3).df.collect()}
    for n in nodes:
        assert np.allclose([got[n].g0, got[n].g1], post[n] / total)
    assert np.isclose(got["r"].loglik, np.log(total))


def test_em_never_loses_likelihood(spark):
    rows = pruning.fit(forest(spark), A, B, PI, 3, iterations=4).orderBy("iteration").collect()
    assert all(y.loglik >= x.loglik - 1e-9 for x, y in itertools.pairwise(rows))


def test_m_steps():
    q = ctmc.m_step_rates(np.array([2.0, 0.0]), np.array([[0, 1.0], [3.0, 0]]))
    assert q[0, 1] == 0.5 and q[1, 0] == 0 and ctmc.m_step_root(np.zeros(2)).tolist() == [0.5, 0.5]
    assert np.isclose(ctmc.m_step_credibility(5, 1, 20, 1), 24 / 25)


def test_forward_backward_equals_enumeration_across_chunks(spark):
    rng = np.random.default_rng(4)
    rows = [(s, float(k), *rng.uniform(0.1, 1, 2).tolist()) for s, n in ((1, 7), (2, 1), (3, 4)) for k in range(n)]
    df = spark.createDataFrame(rows, "sample long, left double, e0 double, e1 double")
    a, pi = np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([0.6, 0.4])
    got = {(r.sample, r.left): r.g1 for r in chains.forward_backward(df, "sample", a, pi, 2.0).collect()}
    assert len(got) == len(rows)
    for s in (1, 2, 3):
        e = np.array([r[2:] for r in rows if r[0] == s])
        post, total = np.zeros(len(e)), 0.0
        for z in itertools.product((0, 1), repeat=len(e)):
            w = pi[z[0]] * np.prod([e[i, z[i]] for i in range(len(e))]) * np.prod([a[z[i - 1], z[i]] for i in range(1, len(e))])
            total += w
            post += w * np.array(z)
        assert np.allclose([got[s, float(k)] for k in range(len(e))], post / total)


def test_smoothing_leaves_single_spans(spark):
    df = spark.createDataFrame([(1, 0.0, 9.0, 0.9, 0.1, "informative"), (2, 0.0, 3.0, 0.9, 0.1, "informative"), (2, 3.0, 6.0, 0.45, 0.55, "informative"), (2, 6.0, 9.0, 0.95, 0.05, "informative")], "sample long, left double, right double, p0 double, p1 double, status string")
    got = {(r.sample, r.left): r.p0 for r in chains.smooth(df, 1e-3, 4.0).collect()}
    assert got[1, 0.0] == 0.9 and got[2, 3.0] > 0.9


def test_time_grid_and_splines():
    edges = splines.time_grid(1, 2000, 40)
    assert np.isclose(splines.split_branch(7, 850, edges).sum(), 843) and np.isclose(splines.split_branch(0.1, 9000, edges).sum(), 8999.9)
    centers = splines.cell_centers(edges)
    exposure = np.full(40, 1e4)
    truth = np.where(centers > 200, 0.02, 0.001)
    rates, _ = splines.best_spline(centers, truth * exposure, exposure)
    assert rates[5] < 0.004 and rates[-3] > 0.012
    assert 100 < splines.split_time(centers, rates, exposure) < 400
    assert np.allclose(splines.basis(np.log(centers), 8).sum(axis=1), 1)
