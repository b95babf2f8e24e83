"""Nearest references along changing trees against a walk through every tree."""

import numpy as np
import pytest

from lociflow.operators import nearest

EDGE, NODE = "left double, right double, parent long, child long", "node long, time double"


def genealogy(seed: int, leaves: int = 9, inner: int = 7, length: int = 40):
    """Random trees on 0 to length: at each of some breakpoints every node below the top takes an older parent, or none."""
    rng = np.random.default_rng(seed)
    times = {i: 0.0 for i in range(leaves)} | {100 + k: float(k + 1) for k in range(inner)}
    cuts = np.unique(np.concatenate([[0, length], rng.integers(1, length, 9)])).tolist()
    held, edges = {}, []
    for a in cuts[:-1]:
        for n in times:
            if a == 0 or rng.random() < 0.3:
                older = [m for m in times if times[m] > times[n]]
                new = int(rng.choice(older)) if older and rng.random() < 0.9 else None
                old = held.get(n)
                if old and old[1] != new:
                    edges.append((float(old[0]), float(a), old[1], n))
                if not old or old[1] != new:
                    held[n] = (a, new)
        # nodes that lost their parent keep (a, None)
    edges += [(float(a), float(length), p, n) for n, (a, p) in held.items()]
    return [e for e in edges if e[2] is not None and e[0] < e[1]], times


def walk(edges, times, refs, sample, at):
    """(reference, depth) by going up the tree at a place."""
    parent = {c: p for a, b, p, c in edges if a <= at < b}
    below = {}
    for r in refs:
        if r == sample:
            continue
        n = r
        while n is not None:
            below.setdefault(n, []).append(r)
            n = parent.get(n)
    n = sample
    while n is not None:
        if n in below:
            return min(below[n]), times[n]
        n = parent.get(n)
    return None


@pytest.mark.parametrize(("seed", "least"), [(1, 4096), (2, 4096), (3, 4), (4, 4)])
def test_equals_a_walk_up_every_tree(spark, seed, least):
    edges, times = genealogy(seed)
    refs, samples = {0: 1, 3: 0, 5: 1, 101: 0}, [0, 1, 2, 3, 4, 5, 6, 7, 8]
    tables = spark.createDataFrame(edges, EDGE), spark.createDataFrame(list(times.items()), NODE), spark.createDataFrame(list(refs.items()), "node long, label int"), spark.createDataFrame([(s,) for s in samples], "sample long")
    got = nearest.nearest(*tables, least=least).collect()
    for s in samples:
        for at in np.arange(0.5, 40):
            here = [(r.reference, r.depth) for r in got if r["sample"] == s and r.left <= at < r.right]
            want = walk(edges, times, refs, s, at)
            assert here == ([] if want is None else [want]), (s, at)


def test_tracks_tile_the_axis(spark):
    edges, times = genealogy(5)
    refs, samples = {0: 1, 3: 0, 5: 2}, [1, 2, 3, 77]
    tables = spark.createDataFrame(edges, EDGE), spark.createDataFrame(list(times.items()), NODE), spark.createDataFrame(list(refs.items()), "node long, label int"), spark.createDataFrame([(s,) for s in samples], "sample long")
    rows = nearest.paint(*tables, 3, 50.0, 8.0).collect()
    for s in samples:
        mine = sorted((r.left, r.right, r.status, (r.p0, r.p1, r.p2)) for r in rows if r["sample"] == s)
        assert mine[0][0] == 0 and mine[-1][1] == 50 and all(a[1] == b[0] and a[2:] != b[2:] for a, b in zip(mine, mine[1:]))
        for at in np.arange(0.5, 50):
            _, _, status, p = next(m for m in mine if m[0] <= at < m[1])
            want = (s, 0.0) if s in refs else walk(edges, times, refs, s, at) if at < 40 else None
            assert status == ("missing-info" if want is None else "informative")
            assert p == ((1 / 3,) * 3 if want is None else tuple(float(refs[want[0]] == k) for k in range(3)))
    deep = nearest.depths(*tables, 50.0, 8.0).where("sample = 3").collect()
    assert sum(r.right - r.left for r in deep) == 50 and any(r.depth is None for r in deep)


def test_members_and_empty_tables(spark):
    one, times = genealogy(6)
    two, _ = genealogy(7)
    edges = spark.createDataFrame([(0, *e) for e in one] + [(1, *e) for e in two], f"member int, {EDGE}")
    nodes = spark.createDataFrame(list(times.items()), NODE)
    refs, samples = spark.createDataFrame([(0, 0), (4, 1)], "node long, label int"), spark.createDataFrame([(1,), (2,)], "sample long")
    both = {tuple(r) for r in nearest.nearest(edges, nodes, refs, samples).collect()}
    for m, some in ((0, one), (1, two)):
        alone = nearest.nearest(spark.createDataFrame(some, EDGE), nodes, refs, samples).collect()
        assert {(m, *tuple(r)[1:]) for r in alone} == {r for r in both if r[0] == m}
    assert nearest.nearest(spark.createDataFrame([], EDGE), nodes, refs, samples).count() == 0
    assert [(r.left, r.right, r.status) for r in nearest.paint(spark.createDataFrame([], EDGE), nodes, refs, samples, 2, 9.0, 3.0).where("sample = 1").collect()] == [(0.0, 9.0, "missing-info")]


def test_a_node_with_many_children_passes_few_rows_on():
    """1500 leaves that come and go under one node, 3 references that stay: a leaf's track is one row, not one for each change of its siblings, and slices are whole."""
    import pyarrow as pa

    from lociflow.operators.nearest import _sweep
    from lociflow.operators.sweep import EXPANDED, Window, slices

    n = 1500
    left = np.append(np.arange(n - 3) / n, [0.0, 0.0, 0.0])
    right = np.append(left[:-3] + 10.0, [20.0, 20.0, 20.0])
    flags = np.append(np.full(n - 3, 2), [1, 1, 3])
    rows = {"left": left, "right": right, "parent": np.full(n, -1), "child": np.arange(n), "tp": np.full(n, 2.0), "tc": np.zeros(n), "vp": np.zeros(n, int), "vc": flags}
    made = list(_sweep(Window(pa.RecordBatch.from_pydict(rows))))
    sample, lo, hi, who = (np.concatenate([m[c] for m in made]) for c in ("sample", "left", "right", "reference"))
    assert len(sample) == n - 2 and sorted(sample.tolist()) == [*range(n - 3), n - 1]
    assert set(who.tolist()) == {n - 3} and (lo == left[sample]).all() and (hi == right[sample]).all()
    assert max(len(m["sample"]) for m in made) <= EXPANDED
    sizes = np.array([0, 60_000, 60_000, 0, 250_000, 1, 0])
    assert [x for a, b in slices(sizes) for x in range(a, b)] == list(range(7)) and max(sizes[a:b].sum() for a, b in slices(sizes)) <= 250_000 + EXPANDED
