"""The registry's painters and their scores, and the result stores."""

import numpy as np
import pytest

from lociflow.operators import nearest, painters
from tests.test_nearest import EDGE, NODE, genealogy

Q, PI = np.array([[-0.3, 0.3], [0.2, -0.2]]), np.array([0.6, 0.4])


def panel(spark):
    edges, times = genealogy(31)
    refs = spark.createDataFrame([(0, 0), (3, 1), (5, 1)], "node long, label int")
    samples = spark.createDataFrame([(s,) for s in range(9)], "sample long")
    return painters.Panel(spark.createDataFrame(edges, EDGE), spark.createDataFrame(list(times.items()), NODE), refs, samples, Q, PI, 40.0, 9.0)


def test_all_painters_tile_and_score(spark):
    p = panel(spark)
    truth = spark.createDataFrame([(s, 0.0, 40.0, s % 2) for s in range(9)], "sample long, left double, right double, state int")
    got = {(r.painter, r.metric): r.value for r in painters.head_to_head(p, truth).collect()}
    assert set(got) == {(n, m) for n in ("nearest", "posterior", "smoothed") for m in ("accuracy", "balanced_accuracy", "confidence", "switches")}
    for name, paint in painters.PAINTERS.items():
        rows = paint(p).collect()
        hit = told = 0.0
        for s in range(9):
            mine = sorted((r for r in rows if r["sample"] == s), key=lambda r: r.left)
            assert mine[0].left == 0 and mine[-1].right == 40 and all(a.right == b.left for a, b in zip(mine, mine[1:]))
            for r in mine:
                if r.status == "informative":
                    told += r.right - r.left
                    hit += (r.right - r.left) * ((r.p1 > r.p0) == (s % 2 == 1))
        assert np.isclose(got[name, "accuracy"], hit / told)
    assert got["nearest", "confidence"] == 1.0 and got["smoothed", "switches"] <= got["posterior", "switches"]


def test_registering_and_missing_names(spark):
    p = panel(spark)
    painters.painter("again")(lambda x: nearest.paint(x.edges, x.nodes, x.references, x.samples, 2, x.length, x.width))
    try:
        truth = spark.createDataFrame([(1, 0.0, 40.0, 1)], "sample long, left double, right double, state int")
        both = {(r.painter, r.metric): r.value for r in painters.head_to_head(p, truth, ["again", "nearest"]).collect()}
        assert all(both["again", m] == both["nearest", m] for _, m in both)
        with pytest.raises(KeyError):
            painters.head_to_head(p, truth, ["none of them"])
    finally:
        del painters.PAINTERS["again"]
