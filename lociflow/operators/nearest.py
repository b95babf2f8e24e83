"""The nearest reference of each sample along a genealogy that changes: whose label it is painted with, and how deep they meet.

Of the references a node's lower neighbours lead to, the two of least id stay with each stretch of the axis: enough to name one that isn't the sample
itself. A least value has no inverse, so what comes and goes can't be a running sum: each child's stretch is laid over its parent's
in two blocks whose length is a power of two, and blocks hand their least values down to their halves. On the way down a node passes its two nearest references, with the
times of the nodes where they meet, to every child; the sample's own is the one that it isn't. Stretches that touch and say the same are one before they are passed on,
so a node with very many children has few, and leaves are told in slices.

edges: (left, right, parent, child); nodes: (node, time); references: (node, label); all with a `member` if they are an ensemble (references may do without). Several
references that meet a sample in one node are equally near: the least id counts. Samples that meet none have no row there. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.cluster import Stored
from lociflow.operators import intervals as iv
from lociflow.operators.sweep import LEAST, Window, for_members, slices, spread, swept

_NOBODY = np.iinfo(np.int64).max
_SCHEMA = "sample long, left double, right double, reference long, depth double"


def _second(first: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """The least of the others that isn't the first."""
    return np.minimum.reduce([np.where(x == first, _NOBODY, x) for x in others])


def least_two(code: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, least, next): for rows that reach from code to end with two values each, the two least different values of every gap between points."""
    points = np.unique(np.concatenate([code, end]))
    first, last = np.searchsorted(points, code), np.searchsorted(points, end)
    one, two = np.full(len(points), _NOBODY), np.full(len(points), _NOBODY)
    level = np.frexp(np.maximum(last - first, 1).astype(float))[1] - 1  # the largest power of two that fits
    for k in range(int(level.max(initial=-1)), -1, -1):
        rows = np.flatnonzero(level == k)
        at = np.concatenate([first[rows], last[rows] - (1 << k)])
        x, y = np.tile(a[rows], 2), np.tile(b[rows], 2)
        before = one.copy()
        np.minimum.at(one, at, x)
        two = _second(one, before, two)
        np.minimum.at(two, at, _second(one[at], x, y))
        if k:
            half = 1 << (k - 1)
            o, t = one.copy(), two.copy()
            o[half:] = np.minimum(one[half:], one[:-half])
            t[half:] = np.minimum(_second(o[half:], one[half:], one[:-half]), _second(o[half:], two[half:], two[:-half]))
            one, two = o, t
    return points, one, two


def _runs(node: np.ndarray, lo: np.ndarray, hi: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows, sorted by node and lo and apart, with those that touch and have equal values (or none) joined."""
    new = (node[1:] != node[:-1]) | (lo[1:] != hi[:-1])
    for x in values:
        new |= (x[1:] != x[:-1]) & ((x[1:] == x[1:]) | (x[:-1] == x[:-1]))
    head = np.flatnonzero(np.append(True, new)[: len(node)])
    return (node[head], lo[head], hi[np.append(head[1:], len(node)) - 1 if len(node) else head], *(x[head] for x in values))


def _sweep(w: Window) -> Iterator[dict[str, np.ndarray]]:
    flags = w.value().to_numpy(zero_copy_only=False).astype(np.int64)
    reference, asked = flags & 1 > 0, flags & 2 > 0
    whole = len(w.pos) - 1
    came: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(w.top + 1)]
    known: list[tuple[np.ndarray, ...]] = []  # (node, lo, hi, least, next) with a reference below
    for h in range(w.top + 1):
        own = np.flatnonzero(reference & (w.height == h))
        parts = [*came[h], (own, np.zeros(len(own), np.int64), np.full(len(own), whole), own, np.full(len(own), _NOBODY))]
        node, lo, hi, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        points, one, two = least_two(w.code(node, lo), w.code(node, hi), a, b)
        at = np.flatnonzero(one[:-1] != _NOBODY) if len(points) else np.zeros(0, np.int64)
        # a gap lies inside one node, as no row reaches from one to another
        here = _runs(points[at] // w.stride, points[at] % w.stride, points[at + 1] % w.stride, one[at], two[at]) if len(at) else tuple(np.zeros(0, np.int64) for _ in range(5))
        known.append(here)
        e = w.edges_at[h]
        i, j, lo, hi = w.meet(here[:3], w.child[e], w.lo[e], w.hi[e])
        above = w.height[w.parent[e[j]]]
        for g in np.unique(above).tolist():
            s = np.flatnonzero(above == g)
            came[g].append((w.parent[e[j[s]]], lo[s], hi[s], here[3][i[s]], here[4][i[s]]))
    edges_of = [[] for _ in range(w.top + 1)]
    for g in range(w.top + 1):
        e = w.edges_at[g]
        up = w.height[w.parent[e]]
        for h in np.unique(up).tolist():
            edges_of[h].append((g, e[up == h]))
    passed: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(w.top + 1)]
    none, never = np.full(0, _NOBODY), np.zeros(0)
    for h in range(w.top, 0, -1):
        node, lo, hi, a, b = known[h]
        got = passed[h] or [(np.zeros(0, np.int64),) * 3 + (none, never, none, never)]
        cn, cl, ch, ca, cta, cb, ctb = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(w.code(cn, cl))
        cn, cl, ch, ca, cta, cb, ctb = (x[order] for x in (cn, cl, ch, ca, cta, cb, ctb))
        points = np.unique(np.concatenate([w.code(node, lo), w.code(node, hi), w.code(cn, cl), w.code(cn, ch)]))
        if len(points) < 2:
            continue
        gap = np.flatnonzero(points[:-1] // w.stride == points[1:] // w.stride)
        v, l, r = points[gap] // w.stride, points[gap] % w.stride, points[gap + 1] % w.stride

        def row(n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """The row that covers each gap, or -1."""
            if not len(n):
                return np.full(len(v), -1)
            i = np.searchsorted(w.code(n, lo), w.code(v, l), side="right") - 1
            j = np.maximum(i, 0)
            return np.where((i >= 0) & (n[j] == v) & (hi[j] >= r), j, -1)

        mine, theirs = row(node, lo, hi), row(cn, cl, ch)
        pick = lambda x, i, empty: np.where(i >= 0, x[np.maximum(i, 0)], empty) if len(x) else np.full(len(i), empty)
        a, b = pick(a, mine, _NOBODY), pick(b, mine, _NOBODY)
        ca, cta, cb, ctb = pick(ca, theirs, _NOBODY), pick(cta, theirs, np.nan), pick(cb, theirs, _NOBODY), pick(ctb, theirs, np.nan)
        t = w.time[v]
        one, one_at = np.where(a != _NOBODY, a, ca), np.where(a != _NOBODY, t, cta)
        below, above = b != _NOBODY, ca != a
        two = np.where(a == _NOBODY, cb, np.where(below, b, np.where(above, ca, cb)))
        two_at = np.where(a == _NOBODY, ctb, np.where(below, t, np.where(above, cta, ctb)))
        keep = one != _NOBODY
        v, l, r, one, one_at, two, two_at = _runs(*(x[keep] for x in (v, l, r, one, one_at, two, two_at)))
        s = np.flatnonzero(asked[v])
        other = one[s] == v[s]
        who, when = np.where(other, two[s], one[s]), np.where(other, two_at[s], one_at[s])
        s, who, when = s[who != _NOBODY], who[who != _NOBODY], when[who != _NOBODY]
        if len(s):
            yield {"sample": w.ids[v[s]], "left": w.pos[l[s]], "right": w.pos[r[s]], "reference": w.ids[who], "depth": when}
        for g, e in edges_of[h]:
            if not g:  # leaves pass nothing on: what isn't themselves is theirs
                e = e[asked[w.child[e]]]
                first, last = w.ranges((v, l, r), w.parent[e], w.lo[e], w.hi[e])
                for x, y in slices(last - first):
                    i, j = spread(first[x:y], last[x:y])
                    edge = e[x:y][j]
                    leaf = w.child[edge]
                    other = one[i] == leaf
                    who, when = np.where(other, two[i], one[i]), np.where(other, two_at[i], one_at[i])
                    met = who != _NOBODY
                    # by edge, as a leaf's edges may follow in any order
                    edge, lo, hi, who, when = _runs(*(z[met] for z in (edge, np.maximum(l[i], w.lo[edge]), np.minimum(r[i], w.hi[edge]), who, when)))
                    if len(edge):
                        yield {"sample": w.ids[w.child[edge]], "left": w.pos[lo], "right": w.pos[hi], "reference": w.ids[who], "depth": when}
                continue
            i, j, lo, hi = w.meet((v, l, r), w.parent[e], w.lo[e], w.hi[e])
            passed[g].append((w.child[e[j]], lo, hi, one[i], one_at[i], two[i], two_at[i]))


def nearest(edges: DataFrame, nodes: DataFrame, references: DataFrame, samples: DataFrame, least: int = LEAST) -> DataFrame:
    """(member, sample, left, right, reference, depth): each sample's nearest reference and the time of the node where they meet.

    A reference among the samples has another one as its nearest.
    """
    on = ["member"] if "member" in nodes.columns and "member" in references.columns else []
    refs = references.select(*on, "node", F.lit(1).alias("__r")).distinct()
    mine = samples.select(F.col("sample").alias("node"), F.lit(2).alias("__s")).distinct()
    flags = F.coalesce("__r", F.lit(0)) + F.coalesce("__s", F.lit(0))
    told = nodes.join(refs, [*on, "node"], "left").join(mine, "node", "left").withColumn("value", flags.cast("long")).drop("__r", "__s")
    return swept(edges, told, _sweep, _SCHEMA, least=least)


def _tiled(rows: DataFrame, samples: DataFrame, members: DataFrame | None, by: list[str], length: float, width: float) -> DataFrame:
    """rows and the stretches of 0 to length that a sample has none in, other columns null."""
    inside = rows.withColumns({"left": F.greatest("left", F.lit(0.0)), "right": F.least("right", F.lit(float(length)))}).where("left < right")
    every = samples.select("sample").distinct()
    if members is not None:
        every = for_members(every, members)
    key = F.struct(*by).alias("key")
    ends = inside.select(key, F.explode(F.array(F.struct(F.col("left").alias("pos"), F.lit(1).alias("held")), F.struct(F.col("right").alias("pos"), F.lit(-1).alias("held")))).alias("end")).select("key", "end.*")
    ends = ends.unionByName(every.select(key, F.explode(F.array(F.lit(0.0), F.lit(float(length)))).alias("pos"), F.lit(0).alias("held")))
    gaps = iv.running(ends, "key", "pos", ["held"], width).where("held = 0 AND left < right").select("key.*", "left", "right")
    return inside.unionByName(gaps, allowMissingColumns=True)


def depths(edges: DataFrame, nodes: DataFrame, references: DataFrame, samples: DataFrame, length: float, width: float, least: int = LEAST) -> DataFrame:
    """(member, sample, left, right, depth): tracks of the time where a sample meets its nearest other reference, null where it meets none, tiling 0 to length."""
    by = ["member", "sample"]
    rows = Stored(nearest(edges, nodes, references, samples, least=least).select(*by, "left", "right", "depth"), "nearest").df
    members = edges if "member" in edges.columns else edges.sparkSession.createDataFrame([(0,)], "member int")
    return iv.merge_runs(_tiled(rows, samples, members, by, length, width), by, ["depth"], width).select(*by, "left", "right", "depth")


def paint(edges: DataFrame, nodes: DataFrame, references: DataFrame, samples: DataFrame, states: int, length: float, width: float, least: int = LEAST) -> DataFrame:
    """Tracks (sample, left, right, p0, p1, ..., status): all of a stretch to the label of the nearest reference, a reference itself to its own.

    Where a sample meets no reference all states are equal and the status is missing-info. edges of an ensemble give the members' tracks, with their member.
    """
    who = ["member"] if "member" in edges.columns else []
    on = ["member"] if who and "member" in references.columns else []
    labels = references.select(*on, F.col("node").alias("reference"), "label")
    own = samples.select("sample").distinct().join(labels.withColumnRenamed("reference", "sample"), "sample").withColumns({"left": F.lit(0.0), "right": F.lit(float(length))})
    if who and not on:
        own = for_members(own, edges)
    found = nearest(edges, nodes, references, samples, least=least).join(labels, [*on, "reference"])
    found = found.join(references.select(*on, F.col("node").alias("sample")).distinct(), [*on, "sample"], "left_anti")
    rows = Stored(found.select(*who, "sample", "left", "right", "label").unionByName(own.select(*who, "sample", "left", "right", "label")), "nearest").df
    every = iv.merge_runs(_tiled(rows, samples, edges if who else None, [*who, "sample"], length, width), [*who, "sample"], ["label"], width)
    share = [F.when(F.col("label").isNull(), F.lit(1.0 / states)).otherwise((F.col("label") == s).cast("double")).alias(f"p{s}") for s in range(states)]
    return every.select(*who, "sample", "left", "right", *share, F.when(F.col("label").isNull(), "missing-info").otherwise("informative").alias("status"))
