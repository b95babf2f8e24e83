import pytest
from pyspark.sql import functions as F

from lociflow.operators import intervals as iv
from lociflow.operators import order
from lociflow.operators.segmentation import hard_segments
from lociflow.operators.topology import coverage, nearest_reference, trees

TRACK = "sample long, left double, right double, p0 double, p1 double, status string"


def track(spark, rows, sample=1):
    return spark.createDataFrame([(sample, a, b, p, 1 - p, "informative") for a, b, p in rows], TRACK)


def spans(df):
    return sorted((r.left, r.right, r.state) for r in df.collect())


def test_markers_tile_the_axis(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 7.0), (2, 5.0)], "sample long, pos double")
    got = iv.tile_markers(df, ["sample"], "pos", 10.0).select("sample", "left", "right").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0.0, 7.0), (1, 7.0, 10.0), (2, 0.0, 10.0)]


@pytest.mark.parametrize("width", [0.7, 5.0, 1000.0])
def test_overlaps_equal_brute_force_for_any_bin_width(spark, width):
    a = [(k % 2, float(k), float(k) + 1.5 + k % 3) for k in range(20)]
    b = [(k % 2, k * 1.3, k * 1.3 + 2.1) for k in range(15)]
    x = spark.createDataFrame([(*r, i) for i, r in enumerate(a)], "sample long, left double, right double, i int")
    y = spark.createDataFrame([(*r, i) for i, r in enumerate(b)], "sample long, left double, right double, j int")
    got = sorted((r.i, r.j, r.lo, r.hi) for r in iv.overlap_join(x, y, ["sample"], width).collect())
    want = sorted((i, j, max(p[1], q[1]), min(p[2], q[2])) for i, p in enumerate(a) for j, q in enumerate(b) if p[0] == q[0] and p[1] < q[2] and q[1] < p[2])
    assert got == want


def test_runs_merge_alike_with_and_without_bins(spark):
    rows = [(1, float(k), float(k + 1), (k // 3) % 2) for k in range(30)] + [(1, 40.0, 41.0, 1)]
    df = spark.createDataFrame(rows, "sample long, left double, right double, state int")
    plain, binned = (spans(iv.merge_runs(df, ["sample"], ["state"], w)) for w in (None, 4.0))
    assert plain == binned and plain[0] == (0.0, 3.0, 0) and plain[-1] == (40.0, 41.0, 1)


def test_hard_segments_literals(spark):
    df = track(spark, [(0.0, 100.0, 0.9), (100.0, 200.0, 0.45), (200.0, 300.0, 0.95)])
    assert len(spans(hard_segments(df, ["p0", "p1"], 0.0))) == 3
    assert spans(hard_segments(df, ["p0", "p1"], 0.3)) == [(0.0, 300.0, 0)]
    blurred = [(0.0, 100.0, 0.9), (100.0, 200.0, 0.55), (200.0, 300.0, 0.45), (300.0, 400.0, 0.1)]
    assert spans(hard_segments(track(spark, blurred), ["p0", "p1"], 0.3)) == [(0.0, 200.0, 0), (200.0, 400.0, 1)]
    mirrored = [(400 - b, 400 - a, p) for a, b, p in reversed(blurred)]
    assert spans(hard_segments(track(spark, mirrored), ["p0", "p1"], 0.3)) == [(0.0, 200.0, 1), (200.0, 400.0, 0)]


def test_segments_without_anchors_take_the_larger_total(spark):
    df = track(spark, [(0.0, 10.0, 0.45), (10.0, 40.0, 0.52)])
    assert spans(hard_segments(df, ["p0", "p1"], 0.3)) == [(0.0, 40.0, 0)]


def test_ensemble_means(spark):
    a = track(spark, [(0.0, 2.0, 0.8), (2.0, 4.0, 0.4)]).withColumn("member", F.lit(0))
    b = track(spark, [(0.0, 1.0, 0.6), (1.0, 4.0, 0.5)]).withColumn("member", F.lit(1)).withColumn("status", F.lit("missing-info"))
    got = iv.merge_members(a.unionByName(b), ["sample"], "member", ["p0", "p1"], 3.0).orderBy("left").collect()
    assert [(r.left, r.right, round(r.p0, 9), round(r.p0_std, 9), r.n_informative, r.status) for r in got] == [(0.0, 1.0, 0.7, 0.1, 1, "informative"), (1.0, 2.0, 0.65, 0.15, 1, "informative"), (2.0, 4.0, 0.45, 0.05, 1, "informative")]


def test_nearest_and_increasing(spark):
    points = spark.createDataFrame([(1, 5.0), (1, 9.0), (2, 1.0)], "sample long, pos double")
    others = spark.createDataFrame([(1, 4.0), (1, 9.0)], "sample long, pos double")
    got = {(r.sample, r.pos): r.distance for r in iv.nearest(points, others, ["sample"]).collect()}
    assert got == {(1, 5.0): 1.0, (1, 9.0): 0.0, (2, 1.0): float("inf")}
    df = spark.createDataFrame([(1, x) for x in (0.2, 0.4, 0.9, 7.5, 7.6)], "sample long, pos double")
    assert [r.position for r in iv.increasing(df, ["sample"], "pos").orderBy("pos").collect()] == [1, 2, 3, 7, 8]


def test_ranks_and_cumulative_shares(spark):
    df = spark.createDataFrame([(x,) for x in (5.0, 1.0, 5.0, 12.0, None)], "v double")
    assert [(r.v, r.rank, r.following) for r in order.ranked(df, "v", 4.0).orderBy("v").collect()] == [(1.0, 0, 5.0), (5.0, 1, 12.0), (12.0, 2, None)]
    got = order.cumulative_share(df.withColumn("w", F.lit(1.0)), [], "v", "w", 4.0).collect()
    assert sorted((r.v, r.share) for r in got if r.v is not None) == [(1.0, 0.25), (5.0, 0.75), (5.0, 0.75), (12.0, 1.0)]


def test_empty_tables_stay_empty(spark):
    empty = spark.createDataFrame([], TRACK)
    assert iv.overlap_join(empty, empty.select("sample", "left", "right"), ["sample"], 1.0).count() == 0
    assert hard_segments(empty, ["p0", "p1"], 0.1).count() == 0


def test_topology(spark):
    edges = spark.createDataFrame([(0.0, 4.0, 1, 10), (2.0, 6.0, 1, 11)], "left double, right double, parent long, child long")
    assert [(r.tree, r.left, r.right) for r in trees(edges, 8.0, 3.0).orderBy("tree").collect()] == [(0, 0.0, 2.0), (1, 2.0, 4.0), (2, 4.0, 6.0), (3, 6.0, 8.0)]
    assert [(r.left, r.right) for r in coverage(edges, "parent", 2.0).collect()] == [(0.0, 6.0)]
    leaves = spark.createDataFrame([("a", 0, "x"), ("b", 1, "x"), ("c", 2, "y")], "node string, rank int, parent string")
    inner = spark.createDataFrame([("x", "r", 1.0), ("y", "r", 1.0), ("r", None, 10.0)], "node string, parent string, time double")
    refs = spark.createDataFrame([("a", 0, 7), ("b", 1, 8)], "node string, rank int, label int")
    got = {r.node: (r.depth, r.label) for r in nearest_reference(leaves, inner, refs).collect()}
    assert got == {"a": (1.0, 8), "b": (1.0, 7), "c": (10.0, 7)}


def test_equal_results_for_any_bin_width(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    rows = [(int(s), float(p), int(k), int(v)) for k, (s, p, v) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 500, 200), rng.integers(0, 2, 200)))]
    df = spark.createDataFrame(rows, "sample long, pos double, id long, v long")
    others = spark.createDataFrame([(int(s), float(p)) for s, p in zip(rng.integers(0, 4, 40), rng.integers(0, 500, 40))], "sample long, pos double")
    windows = spark.createDataFrame([(k, 50.0 * k, 50.0 * k + 70.0) for k in range(10)], "window long, left double, right double")
    want = None
    for width in (None, 7.0, 60.0, 1e6):
        tiled = iv.tile_markers(df, ["sample"], "pos", 500.0, ["id"], width)
        runs = iv.merge_runs(tiled, ["sample"], [], width, weighted="v")
        got = [
            sorted(tuple(r) for r in tiled.select("sample", "left", "right", "id", "v").collect()),
            sorted(tuple(r) for r in iv.switches(tiled, ["sample"], "v", width).collect()),
            sorted(tuple(r) for r in iv.nearest(df.select("sample", "pos"), others, ["sample"], "pos", width).collect()),
            sorted((r.sample, r.left, r.right, round(r.v, 9)) for r in runs.collect()),
            sorted(tuple(r) for r in coverage(df.selectExpr("sample", "pos as left", "pos + 2 as right"), "sample", width or 3.0).select("sample", "left", "right").collect()),
            sorted((r.window, r.sample, r.left, r.right, r.id) for r in iv.clip(tiled, windows, width or 11.0).collect()),
        ]
        want = want or got
        assert got == want
    for sample, pos, distance in want[2]:
        near = [abs(p - pos) for s, p in ((r.sample, r.pos) for r in others.collect()) if s == sample]
        assert distance == min(near, default=float("inf"))


def test_clip_of_many_windows_equals_clip_of_few(spark, monkeypatch):
    tracks = spark.createDataFrame([(k % 5, 3.0 * k, 3.0 * k + 3.0, k) for k in range(40)], "sample long, left double, right double, v long")
    windows = spark.createDataFrame([(k, 10.0 * k, 10.0 * k + 10.0) for k in range(12)], "window long, left double, right double")
    few = sorted(tuple(r) for r in iv.clip(tracks, windows, 8.0).select("sample", "left", "right", "v", "window").collect())
    monkeypatch.setattr(iv, "FEW_WINDOWS", 3)
    assert few == sorted(tuple(r) for r in iv.clip(tracks, windows, 8.0).select("sample", "left", "right", "v", "window").collect()) and len(few) > 40


def test_groups_keep_every_row_and_widen_offsets():
    import pyarrow as pa

    from lociflow.functions.groups import joined, whole_groups

    batches = [pa.RecordBatch.from_pydict({"k": [i // 7] * 3, "t": [f"{i}-{j}" for j in range(3)], "b": [b"x" * j for j in range(3)]}) for i in range(30)]
    out = list(whole_groups(iter([*batches, batches[-1].slice(0, 0)]), ["k"]))
    assert sum(b.num_rows for b in out) == 90 and all(b.schema.field("b").type == pa.large_binary() and b.schema.field("t").type == pa.large_string() for b in out)
    seen = [k for b in out for k in sorted(set(b.column("k").to_pylist()))]
    assert len(seen) == len(set(seen)) == 5
    lists = pa.RecordBatch.from_pydict({"k": [1], "t": ["a"]})
    assert joined([lists]) is lists
