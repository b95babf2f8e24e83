"""Windows, members, masks, smoothing, tall trees, merged and resumed windows, ghosts: each against a plainer way."""

import itertools
import time

import numpy as np
import pytest

from lociflow.operators import chains, ghosts, merging, sweep, weave
from lociflow.streaming import painting

from tests.test_nearest import EDGE, NODE, genealogy

Q = np.array([[-0.5, 0.3, 0.2], [0.1, -0.3, 0.2], [0.4, 0.1, -0.5]])
PI = np.array([0.5, 0.3, 0.2])


def tables(spark, seed, member=None, leaves=9):
    edges, times = genealogy(seed, leaves)
    rng = np.random.default_rng(99)
    e = {n: (rng.dirichlet(np.ones(3)).tolist() if t == 0 else [1.0, 1.0, 1.0]) for n, t in times.items()}
    if member is None:
        return spark.createDataFrame(edges, EDGE), spark.createDataFrame([(n, t, e[n]) for n, t in times.items()], f"{NODE}, e array<double>")
    return spark.createDataFrame([(member, *x) for x in edges], f"member int, {EDGE}"), spark.createDataFrame([(n, t, e[n]) for n, t in times.items()], f"{NODE}, e array<double>")


def at_points(rows, key, fields):
    """What holds at half positions, so that tracks cut differently compare."""
    out = {}
    for r in rows:
        for p in np.arange(0.5, 60):
            if r["left"] <= p < r["right"]:
                out[r[key], p] = np.concatenate([np.atleast_1d(np.asarray(r[f], float)) for f in fields])
    return out


def close(a, b):
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-7) for k in a)


def test_windows_change_nothing(spark):
    edges, nodes = tables(spark, 21)
    whole, parts = (weave.posteriors(edges, nodes, Q, PI, least=n) for n in (4096, 1))
    close(at_points(whole[0].collect(), "node", ["g", "loo"]), at_points(parts[0].collect(), "node", ["g", "loo"]))
    assert len(sweep.borders(edges.selectExpr("*", "0 AS member"), 1)) > 3 and not sweep.borders(edges.selectExpr("*", "0 AS member"))
    one, many = (weave.expected(edges, nodes, Q, PI, least=n) for n in (4096, 1))
    a, b = (weave.statistics(weave.part(x, "branches", False), weave.part(x, "roots", False), Q).first() for x in (one, many))
    assert np.allclose(a.dwell, b.dwell) and np.allclose(a.jumps, b.jumps) and np.allclose(a.root, b.root) and np.isclose(a.loglik, b.loglik)
    joint = weave.statistics(whole[1], whole[2], Q).first()  # the long way, a row for each stretch of the parent
    assert np.allclose(a.dwell, joint.dwell) and np.allclose(a.jumps, joint.jumps)


def test_members_equal_their_own_runs(spark):
    both = [tables(spark, s, m) for m, s in enumerate((22, 23))]
    edges, nodes = both[0][0].unionByName(both[1][0]), both[0][1]
    samples = spark.createDataFrame([(s,) for s in range(9)], "sample long")
    apart = weave.paint(edges, nodes, samples, Q, PI, 45.0, 9.0, merge=False)
    alone = []
    for m, s in enumerate((22, 23)):
        one = weave.paint(*tables(spark, s), samples, Q, PI, 45.0, 9.0)
        alone.append(at_points(one.collect(), "sample", ["p0", "p1", "p2"]))
        close(alone[m], at_points(apart.where(f"member = {m}").collect(), "sample", ["p0", "p1", "p2"]))
    merged = weave.paint(edges, nodes, samples, Q, PI, 45.0, 9.0).collect()
    means = at_points(merged, "sample", ["p0", "p1", "p2", "p0_std"])
    for k, v in means.items():
        x = np.stack([alone[0][k], alone[1][k]])
        assert np.allclose(v[:3], x.mean(axis=0), atol=1e-8) and np.isclose(v[3], x[:, 0].std(), atol=1e-8)
    sums = [weave.statistics(weave.part(x, "branches", False), weave.part(x, "roots", False), Q).first() for x in (weave.expected(e, nodes, Q, PI) for e in (edges, both[0][0], both[1][0]))]
    assert np.allclose(sums[0].dwell, np.add(sums[1].dwell, sums[2].dwell)) and np.isclose(sums[0].loglik, sums[1].loglik + sums[2].loglik)


def test_masks_hold_where_they_are(spark):
    edges, nodes = tables(spark, 24)
    masks = spark.createDataFrame([(1, 5.0, 20.0), (2, 0.0, 60.0), (99, 0.0, 9.0), (1, 12.0, 25.0)], "node long, left double, right double")
    told = {r.node: r.e for r in nodes.collect()}
    got = at_points(weave.posteriors(edges, nodes, Q, PI, masks=masks)[0].collect(), "node", ["g", "loo"])
    for a, b, gone in ((0, 5, {2}), (5, 25, {1, 2}), (25, 60, {2})):
        rows = [(r.node, r.time, PI.tolist() if r.node in gone else r.e) for r in nodes.collect()]
        want = at_points(weave.posteriors(edges, spark.createDataFrame(rows, nodes.schema), Q, PI)[0].collect(), "node", ["g", "loo"])
        here = {k: v for k, v in want.items() if a <= k[1] < b}
        close(here, {k: v for k, v in got.items() if a <= k[1] < b})
    assert told[1] != PI.tolist()


def test_a_tree_of_height_200(spark):
    n = 200
    edges = [(0.0, 10.0, 1000, 0), (0.0, 10.0, 1000, 1)] + [(0.0, 10.0 if k % 7 else 6.0, 1000 + k, 999 + k) for k in range(1, n)] + [(0.0, 10.0, 1000 + k, k + 1) for k in range(1, n)]
    nodes = [(k, 0.0, [0.8, 0.1, 0.1] if k % 2 else [0.1, 0.1, 0.8]) for k in range(n + 1)] + [(1000 + k, (k + 1) / 50, [1.0] * 3) for k in range(n)]
    weave.posteriors(*(spark.createDataFrame(x, s) for x, s in ((edges[:3], EDGE), (nodes, f"{NODE}, e array<double>"))), Q, PI)[0].count()
    began = time.time()
    got = weave.posteriors(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, f"{NODE}, e array<double>"), Q, PI)[0]
    rows = got.collect()
    assert time.time() - began < 60 and {r.node for r in rows} == {x[0] for x in nodes} and all(np.isclose(sum(r.g), 1) for r in rows)


@pytest.mark.parametrize("k", [2, 3, 4])
def test_smoothing_equals_every_path(spark, k):
    rng = np.random.default_rng(k)
    pi, eps, n = rng.dirichlet(np.ones(k)), 0.2, 5
    p = rng.dirichlet(np.ones(k), n)
    rows = [(1, 3, float(i), i + 1.0, *map(float, p[i])) for i in range(n)] + [(1, 4, 0.0, 1.0, *map(float, p[0]))]
    df = spark.createDataFrame(rows, "member int, sample int, left double, right double, " + ", ".join(f"p{s} double" for s in range(k)))
    got = {(r.sample, r.left): [r[f"p{s}"] for s in range(k)] for r in chains.smooth(df, eps, 2.0, tuple(pi), ["member", "sample"]).collect()}
    step, want = (1 - eps) * np.eye(k) + eps / k, np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = np.prod([p[i][s] / pi[s] for i, s in enumerate(path)]) * np.prod([step[a, b] for a, b in itertools.pairwise(path)])
        for i, s in enumerate(path):
            want[i, s] += w
    assert all(np.allclose(got[3, float(i)], want[i] / want[i].sum()) for i in range(n)) and np.allclose(got[4, 0.0], p[0])


def test_merged_windows_paint_like_the_uncut(spark):
    edges, nodes = tables(spark, 25)
    inner = {100 + k: 9 + k for k in range(7)}
    number = lambda n: inner.get(n, n)
    cut = [(k, m, max(a, 20.0 * k) - 20 * k, min(b, 20.0 * k + 20) - 20 * k, number(p), number(c)) for a, b, p, c in genealogy(25)[0] for k in (0, 1) for m in (0, 5) if a < 20 * k + 20 and b > 20 * k]
    each = [(k, m, number(r.node), r.time) for r in nodes.collect() for k in (0, 1) for m in (0, 5)] + [(0, 8, 0, 0.0)]
    windows = spark.createDataFrame([(0, 0.0, 20.0), (1, 20.0, 40.0)], "window int, left double, right double")
    joined, numbered = merging.merged(spark.createDataFrame(cut, f"window int, member int, {EDGE}"), spark.createDataFrame(each, f"window int, member int, {NODE}"), windows)
    assert {r.member for r in numbered.collect()} == {0, 5} and numbered.where("member = 0").count() == 9 + 2 * 7
    told = numbered.join(nodes.where("time = 0").select("node", "e"), "node", "left").selectExpr("member", "node", "time", "coalesce(e, array(1.0D, 1.0D, 1.0D)) e")
    samples = spark.createDataFrame([(s,) for s in range(9)], "sample long")
    whole = at_points(weave.paint(edges, nodes, samples, Q, PI, 40.0, 9.0).collect(), "sample", ["p0", "p1", "p2"])
    close(whole, at_points(weave.paint(joined, told, samples, Q, PI, 40.0, 9.0, merge=False).where("member = 5").collect(), "sample", ["p0", "p1", "p2"]))


def test_sampler_tables(spark):
    times = [0.0, 0.0, 0.0, 5.0, 5.0, 4.0, 7.0, 7.00001, 0.5]
    nodes = spark.createDataFrame(list(enumerate(times)), NODE).repartition(3)
    branches = spark.createDataFrame([(0.0, 12.0, 3, 0), (0.0, 10.0, -1, 3)], EDGE)
    prev, want = -1.0, {}
    for n, t in enumerate(times):
        if t:
            t = prev = max(prev + 1e-4, t)
        want[n] = t
    for block in (2, 1000):
        edges, got = merging.sampled(nodes, branches, 10.0, block=block)
        assert all(np.isclose(r.time, want[r.node], atol=1e-12) for r in got.collect()) and got.count() == len(times)
    assert [tuple(r) for r in edges.collect()] == [(0.0, 10.0, 3, 0)]
    marks = spark.createDataFrame([(1.0, 3, 4, 1), (1.0, 3, 4, 1), (10.0, 0, 0, 0)], "pos double, node long, upper long, state int")
    assert [tuple(r) for r in merging.sites(marks, 10.0).collect()] == [(1.0, 3, 1)]


def test_stopped_and_resumed(spark, tmp_path, monkeypatch):
    edges, nodes = tables(spark, 26)
    samples = spark.createDataFrame([(s,) for s in range(9)], "sample long")
    folder, count, right = f"file://{tmp_path}/painted", [0], weave.paint

    def breaks(*a, **k):
        count[0] += 1
        if count[0] == 3:
            raise RuntimeError("stopped")
        return right(*a, **k)

    monkeypatch.setattr(painting.weave, "paint", breaks)
    with pytest.raises(Exception, match="stopped"):
        painting.paint_windows(edges, nodes, samples, Q, PI, 45.0, 10.0, folder)
    early = painting.WindowedPainting.load(spark, folder)
    assert {r.window for r in early.tracks().select("window").distinct().collect()} == {0, 1}
    done = painting.paint_windows(edges, nodes, samples, Q, PI, 45.0, 10.0, folder)
    assert count[0] == 6 and len(done.bounds) == 5  # two, the one that broke, and three
    whole = at_points(right(edges, nodes, samples, Q, PI, 45.0, 9.0).collect(), "sample", ["p0", "p1", "p2"])
    close(whole, at_points(done.painting().collect(), "sample", ["p0", "p1", "p2"]))
    a, b, second = list(done.windows())[1]
    assert (a, b) == (10.0, 20.0) and {(r.left >= a, r.right <= b) for r in second.collect()} == {(True, True)}
    with pytest.raises(ValueError, match="another"):
        painting.paint_windows(edges, nodes, samples, Q, PI, 44.0, 10.0, folder)


@pytest.mark.parametrize("by", ["time", "rank"])
def test_ghosts_are_found(spark, by):
    """Deep stretches of some samples, in two members, beyond anything the references show."""
    rng = np.random.default_rng(4)
    rows, deep = [], set()
    for m in (0, 1):
        for s in range(12):
            for k in range(40):
                ghost = s >= 8 and 10 <= k < 22
                depth = float(np.exp(rng.normal(9.5 if ghost else 6.0, 0.3)))
                rows.append((m, s, float(k), k + 1.0, depth if (s, k) != (8, 15) else None))
                if ghost:
                    deep.add((s, float(k)))
    df = spark.createDataFrame(rows, "member int, sample long, left double, right double, depth double")
    refs = spark.createDataFrame([(s,) for s in range(5)], "node long")
    found = ghosts.detect(df, refs, 10.0, by, iterations=15)
    got = {(r["sample"], r.left): r for r in found.posteriors.collect()}
    right = np.mean([(r.p1 > 0.5) == (k in deep) for k, r in got.items()])
    assert len(got) == 7 * 40 and right > 0.97 and got[8, 15.0].status == "missing-info"
    assert found.mean >= found.anchor.floor and found.deviation <= found.anchor.scale + 1e-12
    burden = {r["sample"]: r.burden for r in found.burden().collect()}
    assert all(burden[s] > 0.2 for s in range(8, 12)) and all(burden[s] < 0.05 for s in (5, 6, 7))
    tracts = [r for r in found.tracts(0.5, 10.0).collect() if r["sample"] == 9]
    assert [(r.left, r.right) for r in tracts] == [(10.0, 22.0)]
    with pytest.raises(ValueError, match="compare"):
        ghosts.detect(df, spark.createDataFrame([], "node long"), 10.0, by)
