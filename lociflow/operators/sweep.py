"""Windows of the axis, dealt to tasks, and the interval arithmetic that sweeps over the nodes of one.

edges: (left, right, parent, child); nodes: (node, time, value). Both may have a `member`, the genealogy of an ensemble they belong to; nodes
without one serve all members. A window is a stretch of the axis with about as many edge ends as a quarter of the edges that live at one place (LEAST at
least), so clipping edges to windows adds a few rows an edge; a task holds one member's window. Borders of windows are
quantiles of edge ends, moved on to where no edge ends, so that whatever ends at a border is cut there; one number a window on the driver, MOST at most.
Edges may have `n`: so many alike.

Inside a window positions are numbered, so intervals of a node are pairs of whole numbers and (node, position) is one key to search for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.cluster import ship
from lociflow.functions.groups import bounds, whole_groups

LEAST, MOST = 4096, 10_000
_ROWS = 50_000


def borders(edges: DataFrame, least: int = LEAST, masks: DataFrame | None = None) -> list[float]:
    """Where windows meet, between the ends of edges (and masks); edges have a member."""
    span = F.col("right") - F.col("left")
    s = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(span).alias("alive"), F.min("left").alias("a"), F.max("right").alias("b"), F.approx_count_distinct("member").alias("m")).first()
    if not s.n:
        return []
    m = max(1, s.m)
    per = max(least, s.alive / (s.b - s.a) / 4 / m)
    n = min(MOST, int(np.ceil(2 * s.n / m / per)))
    if n < 2:
        return []
    shares = [k / n for k in range(1, n)]
    cuts = edges.select(F.explode(F.array("left", "right")).alias("x")).agg(F.percentile_approx("x", F.array(*[F.lit(x) for x in shares]), F.lit(max(10_000, 10 * n)))).first()[0]
    cuts = sorted({float(x) for x in cuts if s.a < x < s.b})
    places = [rows.select(F.explode(F.array(*[F.col(c).cast("double") for c in ("left", "right")])).alias("x")) for rows in (edges, masks) if rows is not None]
    places = places[0] if len(places) == 1 else places[0].unionByName(places[1])
    beyond = np.array(cuts) + 4e-12 * np.maximum(np.abs(cuts), 1.0)  # a place that begins at an end isn't cut in two

    def following(batches):
        for batch in batches:
            x = batch.column("x").drop_null().to_numpy()
            x = x[x > beyond[0]]
            at, least_x = np.searchsorted(beyond, x) - 1, np.full(len(beyond), np.inf)
            np.minimum.at(least_x, at, x)
            met = np.flatnonzero(np.isfinite(least_x))
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(least_x[met])], ["k", "x"])

    after = {r.k: r.x for r in places.mapInArrow(following, "k int, x double").groupBy("k").agg(F.min("x").alias("x")).collect()} if cuts else {}
    moved = [(x, x + (after[k] - x) / 2, after[k]) for k, x in enumerate(cuts) if k in after]
    return [m for x, m, y in moved if x < m < y]


def _members(rows: DataFrame) -> DataFrame:
    return rows if "member" in rows.columns else rows.withColumn("member", F.lit(0))


def for_members(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows once for each member of an ensemble's edges; members are few, a name each on the driver."""
    names = [r.member for r in edges.select("member").distinct().collect()]
    if not names:
        return rows.withColumn("member", F.lit(None).cast(edges.schema["member"].dataType)).limit(0)
    return rows.withColumn("member", F.explode(F.array(*[F.lit(x) for x in names])))


def dealt(edges: DataFrame, nodes: DataFrame, masks: DataFrame | None = None, least: int = LEAST) -> tuple[DataFrame, np.ndarray]:
    """(rows, borders of windows): (member, window, left, right, parent, child, n, tp, tc, vp, vc) sorted by member and window, a task a window or a few.

    masks: (node, left, right), perhaps with a value, come as rows without parent. Edges without stretch, without time, with null ends or unknown nodes are left out.
    """
    ship(edges.sparkSession)
    own = "member" in edges.columns
    n = F.col("n").cast("double") if "n" in edges.columns else F.lit(1.0)
    edges = _members(edges).where("left < right").select("member", "left", "right", "parent", "child", n.alias("n"))
    on = ["member"] if own and "member" in nodes.columns else []
    end = lambda name, t, v: nodes.select(*on, F.col("node").alias(name), F.col("time").alias(t), F.col("value").alias(v))
    rows = edges.join(end("child", "tc", "vc"), [*on, "child"]).join(end("parent", "tp", "vp"), [*on, "parent"]).where("tp > tc")
    rows = rows.select("member", "left", "right", "parent", "child", "n", "tp", "tc", "vp", "vc")
    cuts = np.array(borders(edges, least, masks))
    if masks is not None:
        spans = _members(masks).where("left < right").select("member", "left", "right", F.col("node").alias("child"), *([F.col("value").alias("vc")] if "value" in masks.columns else []))
        spans = spans if "member" in masks.columns or not own else for_members(spans.drop("member"), edges)
        rows = rows.unionByName(spans, allowMissingColumns=True)
    if not len(cuts):
        rows = rows.withColumn("window", F.lit(0))
    else:
        kinds = rows.schema.simpleString()[7:-1].replace(":", " ")

        def clip(batches):
            for batch in batches:
                left, right = batch.column("left").to_numpy(), batch.column("right").to_numpy()
                first, last = np.searchsorted(cuts, left, side="right"), np.searchsorted(cuts, right, side="left")
                n = last - first + 1
                which = np.repeat(np.arange(len(n)), n)
                window = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                walls = np.concatenate([[-np.inf], cuts, [np.inf]])
                ends = {"left": np.maximum(left[which], walls[window]), "right": np.minimum(right[which], walls[window + 1])}
                took = batch.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*[pa.array(ends[c]) if c in ends else took.column(c) for c in batch.schema.names], pa.array(window, pa.int32())], [*batch.schema.names, "window"])

        rows = rows.mapInArrow(clip, f"{kinds}, window int")
    tasks = min(MOST, max(8, 4 * (len(cuts) + 1)))  # a number of its own: what a window makes is far more than it reads
    return rows.repartition(tasks, "member", "window").sortWithinPartitions("member", "window"), cuts


def running(node: np.ndarray, pos: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, left, right, sums...): between neighbouring positions of a node, the sum of all rows (values, two-dimensional) up to the left one."""
    order = np.lexsort((pos, node))
    node, pos = node[order], pos[order]
    if not len(node):
        return (node, pos, pos, *values)
    new = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (pos[1:] != pos[:-1])))
    node, pos = node[new], pos[new]
    head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    sizes = np.diff(np.append(head, len(node)))
    stays = np.flatnonzero(node[1:] == node[:-1])
    out = []
    for v in values:
        wide = v.astype(np.longdouble) if v.dtype.kind == "f" else v  # what came and went leaves nothing behind
        each = np.add.reduceat(wide[order], new, axis=0)
        total = np.cumsum(each, axis=0)
        out.append((total - np.repeat(total[head] - each[head], sizes, axis=0))[stays].astype(v.dtype))
    return (node[stays], pos[stays], pos[stays + 1], *out)


class Window:
    """One window of one genealogy: edges and nodes by number, heights, keys of (node, position)."""

    def __init__(self, batch: pa.RecordBatch):
        real = batch.column("parent").is_valid().to_numpy(zero_copy_only=False)
        self.rows, marks = batch.filter(pa.array(real)), batch.filter(pa.array(~real))
        left, right = (np.concatenate([b.column(c).to_numpy() for b in (self.rows, marks)]) for c in ("left", "right"))
        self.pos, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        n, m = self.rows.num_rows, len(left)
        self.lo, self.hi, self.mark_lo, self.mark_hi = at[:n], at[m : m + n], at[n:m], at[m + n :]
        ends = np.concatenate([self.rows.column(c).to_numpy() for c in ("parent", "child")])
        self.ids, at, where = np.unique(ends, return_index=True, return_inverse=True)[0], None, None
        self.parent, self.child = np.searchsorted(self.ids, ends[:n]), np.searchsorted(self.ids, ends[n:])
        known = np.isin(marks.column("child").to_numpy(), self.ids)
        self.mark_lo, self.mark_hi = self.mark_lo[known], self.mark_hi[known]
        self.mark = np.searchsorted(self.ids, marks.column("child").to_numpy()[known])
        self.mark_values = marks.column("vc").filter(pa.array(known))
        self.first = np.empty(len(self.ids), np.int64)  # a place in (children, parents) where each node stands
        self.first[self.parent], self.first[self.child] = n + np.arange(n), np.arange(n)
        self.tc, self.tp = self.rows.column("tc").to_numpy(), self.rows.column("tp").to_numpy()
        self.n = self.rows.column("n").to_numpy() if "n" in self.rows.schema.names else np.ones(n)
        self.time = np.concatenate([self.tc, self.tp])[self.first]
        self.stride = len(self.pos) + 1
        self.height = np.zeros(len(self.ids), np.int64)
        live = np.arange(n)
        while len(live):
            want = self.height[self.child[live]] + 1
            low = want > self.height[self.parent[live]]
            np.maximum.at(self.height, self.parent[live[low]], want[low])
            moved = np.zeros(len(self.ids), bool)
            moved[self.parent[live[low]]] = True
            live = np.flatnonzero(moved[self.child])
        self.top = int(self.height.max(initial=0))
        order = np.argsort(self.height[self.child], kind="stable")
        cuts = np.searchsorted(self.height[self.child][order], np.arange(self.top + 2))
        self.edges_at = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def value(self) -> pa.Array:
        """The nodes' values."""
        both = pa.concat_arrays([self.rows.column("vc"), self.rows.column("vp")])
        return both.take(pa.array(self.first))

    def code(self, node: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return node * self.stride + pos

    def ranges(self, a: tuple[np.ndarray, ...], node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval of a node, which rows (first, last) of a, (node, lo, hi) sorted and apart, it meets."""
        first = np.searchsorted(self.code(a[0], a[2]), self.code(node, lo), side="right")
        last = np.searchsorted(self.code(a[0], a[1]), self.code(node, hi), side="left")
        return first, np.maximum(first, last)

    def meet(self, a: tuple[np.ndarray, ...], node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row of a, interval, lo, hi) wherever they overlap."""
        first, last = self.ranges(a, node, lo, hi)
        ia, ib = spread(first, last)
        return ia, ib, np.maximum(a[1][ia], lo[ib]), np.minimum(a[2][ia], hi[ib])


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(every number from first to last, the row it belongs to)."""
    n = last - first
    row = np.repeat(np.arange(len(n)), n)
    return first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), row


#: Rows that stretches are laid over each other to at once.
EXPANDED = 100_000


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring rows (from, to) that come to about EXPANDED together, or single ones."""
    upto = np.cumsum(sizes)
    cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, EXPANDED)), len(upto))) if len(upto) else []
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def swept(edges: DataFrame, nodes: DataFrame, sweep: Callable[[Window], Iterator[dict[str, np.ndarray]]], schema: str, masks: DataFrame | None = None, least: int = LEAST) -> DataFrame:
    """What `sweep` yields for each window, with its member: columns of the schema, two-dimensional ones as arrays; missing ones are null.

    A column `cut` of the schema is filled in: 1 where a row's left end is a border of windows, and 2 more where its right end is.
    """
    rows, walls = dealt(edges, nodes, masks, least)
    member = dict(rows.dtypes)["member"]
    out = edges.sparkSession.createDataFrame([], f"member {member}, {schema}").schema
    names = out.fieldNames()

    def column(value: np.ndarray | None, kind: pa.DataType, n: int) -> pa.Array:
        if value is None:
            return pa.nulls(n, kind)
        if value.ndim == 1:
            return pa.array(value).cast(kind)
        return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(value).ravel()), value.shape[1]).cast(kind)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(out)

    def run(batches):
        for group in whole_groups(batches, ["member", "window"]):
            cuts = bounds(group, ["member", "window"])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = group.slice(a, b - a)
                if part.column("parent").null_count == part.num_rows:
                    continue
                for made in sweep(Window(part)):
                    if "cut" in names and "left" in made:
                        made["cut"] = (np.isin(made["left"], walls) + 2 * np.isin(made["right"], walls)).astype(np.int8)
                    total = len(next(iter(made.values())))
                    for i in range(0, total, _ROWS):
                        n = min(_ROWS, total - i)
                        yield pa.RecordBatch.from_arrays([pa.repeat(part.column("member")[0], n).cast(kinds.field("member").type), *[column(None if c not in made else made[c][i : i + n], kinds.field(c).type, n) for c in names[1:]]], schema=kinds)

    return rows.mapInArrow(run, out)
