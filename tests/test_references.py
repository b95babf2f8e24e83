import itertools

import numpy as np

from lociflow.operators import dating, order, references, weave

STATES = ["p0", "p1", "p2"]
TRACKS = [
    (1, 0.0, 4.0, 0.8, 0.1, 0.1, "informative"), (1, 4.0, 8.0, 0.1, 0.1, 0.8, "informative"), (1, 8.0, 10.0, 0.2, 0.1, 0.7, "informative"),
    (2, 0.0, 10.0, 0.1, 0.9, 0.0, "informative"), (3, 0.0, 5.0, 0.1, 0.2, 0.7, "informative"), (3, 5.0, 10.0, 0.3, 0.3, 0.4, "missing-info"),
    (4, 0.0, 10.0, 1 / 3, 1 / 3, 1 / 3, "informative"), (5, 0.0, 10.0, 0.2, 0.3, 0.5, "missing-info"),
]


def given(spark):
    tracks = spark.createDataFrame(TRACKS, "sample long, left double, right double, p0 double, p1 double, p2 double, status string")
    return tracks, spark.createDataFrame([(1, 0), (2, 1), (3, 0), (5, 2)], "node long, label int")


def test_agreement_anchors_and_tracts(spark):
    tracks, refs = given(spark)
    got = {r.node: (r.agreement, r.told) for r in references.agreement(tracks, refs, STATES).collect()}
    assert np.isclose(got[1][0], (0.8 * 4 + 0.1 * 4 + 0.2 * 2) / 10) and got[2] == (0.9, 10.0) and got[3] == (0.1, 5.0) and got[5] == (None, 0.0)
    agreed = references.agreement(tracks, refs, STATES)
    assert sorted(r.node for r in references.anchors(agreed, 0.5).collect()) == [1, 2]
    assert sorted(r.node for r in references.anchors(agreed, 1.0).collect()) == [1, 2, 3]
    tied = spark.createDataFrame([(k, 0.5 if k % 3 else None) for k in range(30)], "node long, agreement double")
    assert sorted(r.node for r in references.anchors(tied, 0.2).collect()) == [1, 2, 4, 5, 7, 8]
    flagged = sorted(tuple(r) for r in references.flagged(tracks, refs, STATES, 0.3).collect())
    assert flagged == [(1, 4.0, 10.0, 2), (3, 0.0, 5.0, 2)]
    assert sorted(tuple(r) for r in references.mask(references.flagged(tracks, refs, STATES)).collect()) == [(1, 4.0, 10.0), (3, 0.0, 5.0)]
    w = {r.node: r.w for r in references.learned_credibility(agreed).collect()}
    assert np.isclose(w[2], (19 + 9) / (19 + 10)) and np.isclose(w[5], 1.0)


def test_foreign_tracts_with_and_without_depth(spark):
    tracks, refs = given(spark)
    got = sorted(tuple(r) for r in references.foreign_tracts(tracks, refs, STATES, 0.5, width=3.0).collect())
    assert [r[:3] for r in got] == [(1, 4.0, 10.0), (3, 0.0, 5.0), (4, 0.0, 10.0)]
    assert np.isclose(got[0][3], (0.9 * 4 + 0.8 * 2) / 6) and np.isclose(got[2][3], 1.0)
    depths = spark.createDataFrame([(1, 0.0, 6.0, 5.0), (1, 6.0, 10.0, 1.0), (3, 0.0, 10.0, 9.0), (4, 0.0, 10.0, None)], "sample long, left double, right double, depth double")
    deep = sorted(tuple(r)[:3] for r in references.foreign_tracts(tracks, refs, STATES, 0.5, depths, 0.3, 2.0, 3.0).collect())
    assert deep == [(1, 4.0, 6.0), (3, 0.0, 5.0)]
    ranks = {r.depth: r.share for r in order.cumulative_share(depths.selectExpr("depth", "right - left as w"), [], "depth", "w", 2.0).collect()}
    assert np.isclose(ranks[1.0], 0.2) and np.isclose(ranks[5.0], 0.5) and ranks[9.0] == 1.0 and ranks[None] is None


def panel(spark, wrong):
    """Two groups of eight leaves under parents of their own, over two stretches; one leaf may carry the other group's label."""
    edges, nodes = [], [(100, 1.0), (101, 1.0), (200, 6.0)]
    for k in range(16):
        edges.append((0.0, 10.0, 100 + k // 8, k))
        nodes.append((k, 0.0))
    edges += [(0.0, 10.0, 200, 100), (0.0, 10.0, 200, 101)]
    labels = [(k, 1 - k // 8 if k == wrong else k // 8) for k in range(16)]
    return (
        spark.createDataFrame(edges, "left double, right double, parent long, child long"),
        spark.createDataFrame(nodes, "node long, time double"),
        spark.createDataFrame(labels, "node long, label int"),
    )


def test_audit_finds_the_mislabelled_reference(spark):
    q = np.array([[-0.1, 0.1], [0.1, -0.1]])
    found = references.audit(*panel(spark, 3), q, np.array([0.5, 0.5]), 10.0, 50.0, iterations=2)
    rows = {r.node: r for r in found.credibility.collect()}
    assert min(rows, key=lambda n: rows[n].agreement) == 3 and rows[3].credibility < 0.8 and not rows[3].is_anchor
    assert sum(r.is_anchor for r in rows.values()) == 8 and min(r.credibility for n, r in rows.items() if n != 3) > rows[3].credibility
    share = {r.node: r.foreign_share for r in found.summary(["p0", "p1"], 10.0).collect()}
    assert share[3] == 1.0 and all(s == 0 for n, s in share.items() if n != 3)
    assert [r.node for r in references.soft_references(found.credibility, 0.8).collect()] == [3]


def test_rates_by_cell_equal_small_steps():
    q = np.array([[[-0.2, 0.2], [0.1, -0.1]], [[-0.05, 0.05], [0.4, -0.4]], [[-0.3, 0.3], [0.3, -0.3]]])
    rates = weave.ByCell(q, np.array([1.0, 2.0, 4.0, 8.0]))
    child, parent = np.array([0.0, 1.5, 3.0]), np.array([6.0, 3.5, 20.0])
    assert np.allclose(rates.stays(child, parent).sum(axis=1), parent - child)
    moves = rates.moves(child, parent)
    x = np.array([[[0.4, 0.1], [0.2, 0.3]]] * 3)
    dwell, jumps = rates.rewards(child, parent, x)
    want_d, want_j = np.zeros_like(dwell), np.zeros_like(jumps)
    for b in range(3):
        steps = 20_000
        t = (np.arange(steps) + 0.5) / steps * (parent[b] - child[b]) + child[b]
        cell = np.clip(np.searchsorted(rates.edges, t, side="right") - 1, 0, 2)
        length = (parent[b] - child[b]) / steps
        single = [weave.transitions(q[c], np.array([length]))[0] for c in range(3)]
        older = [np.eye(2)]
        for c in cell[::-1]:
            older.append(older[-1] @ single[c])
        assert np.allclose(older[-1], moves[b], atol=1e-4)
        younger = [np.eye(2)]
        for c in cell:
            younger.append(single[c] @ younger[-1])
        for i, c in enumerate(cell[::-1]):
            a, z = older[i], younger[steps - 1 - i]
            inner = np.einsum("im,nj->mnij", a, z)
            value = (inner * (x[b] / moves[b])[None, None]).sum(axis=(2, 3)) * length
            want_d[c] += np.diag(value)
            want_j[c] += q[c] * value * (1 - np.eye(2))
    assert np.allclose(dwell, want_d, rtol=2e-3) and np.allclose(jumps, want_j, rtol=2e-3)
    assert np.isclose(dwell.sum(), (x.sum(axis=(1, 2)) * (parent - child)).sum())


def test_one_cell_is_a_constant_rate(spark):
    q, pi = np.array([[-0.1, 0.1], [0.2, -0.2]]), np.array([0.5, 0.5])
    edges, nodes, labels = panel(spark, None)
    told = nodes.join(labels, "node", "left").selectExpr("node", "time", "CASE WHEN label = 0 THEN array(1D, 0D) WHEN label = 1 THEN array(0D, 1D) ELSE array(1D, 1D) END AS e")
    _, joints, roots = weave.posteriors(edges, told, q, pi, 50.0)
    s = weave.statistics(joints, roots, q).first()
    rates = weave.ByCell(q[None], np.array([0.5, 7.0]))
    _, again, _ = weave.posteriors(edges, told, rates, pi, 50.0)
    (c,) = weave.cell_statistics(again, rates).collect()
    assert np.allclose(c.dwell, s.dwell) and np.allclose(c.jumps, s.jumps)


def test_rate_through_time_has_its_rates_above_the_split(spark):
    """All change lies on the two branches from 1 to 6, so the rate is high there and low below."""
    edges, nodes, labels = panel(spark, None)
    told = nodes.join(labels, "node", "left").selectExpr("node", "time", "CASE WHEN label = 0 THEN array(1D, 0D) WHEN label = 1 THEN array(0D, 1D) ELSE array(1D, 1D) END AS e")
    times = np.array([0.25, 0.5, 1.0, 2.0, 4.0, 8.0])
    found = dating.rate_through_time(edges, told, np.array([[-0.05, 0.05], [0.05, -0.05]]), np.array([0.5, 0.5]), times, 50.0, iterations=3)
    both = found.q[:, 0, 1] + found.q[:, 1, 0]
    assert both[-1] > 3 * both[0] and all(b > a for a, b in itertools.pairwise(found.history))
    assert found.split_times()[0, 1] > 0.7 and found.table(spark).count() == 10
    assert dating.grid(told, 5)[0] == 1.0


def test_split_times():
    from lociflow.functions import splines

    c = np.array([1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0])
    rising = np.array([1, 1, 1, 1, 5, 9, 9, 9.0])
    even = np.ones(8)
    assert splines.split_time(c, rising, even) == 16.0 and splines.split_time(c, rising[::-1], even) == 8.0
    assert splines.split_time(c, even, even) is None and splines.split_time(c[:1], rising[:1], even[:1]) is None
    assert splines.split_time(c, np.append(rising[:-1], 1000), np.append(even[:-1], 1e-3)) == 16.0
    dwell, jumps = np.ones((8, 2)), np.zeros((8, 2, 2))
    jumps[:, 0, 1] = rising
    assert splines.split_times(c, dwell, jumps) == {(0, 1): 16.0}


def test_poisson_spline_is_where_its_gradient_is_zero():
    from lociflow.functions import splines

    centers = splines.cell_centers(splines.time_grid(1, 1000, 40))
    rng = np.random.default_rng(2)
    exposure = np.where(np.arange(40) % 11 == 5, 0.0, rng.uniform(10, 1000, 40))
    events = rng.poisson(exposure * 0.02 * (1 + np.sin(np.log(centers)))).astype(float)
    for smoothing in (0.1, 10.0, 1e3):
        rates, deviance, edf = splines.poisson_spline(centers, events, exposure, smoothing)
        b = splines.basis(np.log(centers), 25)
        rough = np.diff(np.eye(b.shape[1]), n=2, axis=0)
        coef = np.linalg.lstsq(b, np.log(rates), rcond=None)[0]
        objective = lambda v: (exposure * np.exp(b @ v) - events * (b @ v)).sum() + smoothing / 2 * ((rough @ v) ** 2).sum()  # noqa: B023, E731
        base = objective(coef)
        assert all(objective(coef + 1e-3 * rng.standard_normal(len(coef))) > base - 1e-6 for _ in range(50))
        assert 0 < edf < 40 and deviance > 0
