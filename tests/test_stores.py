"""Result stores and identifier files: what is written comes back."""

import numpy as np

from lociflow.operators import dating, ghosts, references
from lociflow.sources import stores


def test_fits_come_back(spark, tmp_path):
    q, pi = np.array([[-1.0, 0.4, 0.6], [0.2, -0.2, 0.0], [0.1, 0.3, -0.4]]), np.array([0.2, 0.3, 0.5])
    stores.params_table(spark, q, pi, [-3.0, -2.5]).write.parquet(f"{tmp_path}/fit")
    a, b = stores.load_params(f"{tmp_path}/fit")
    assert np.array_equal(a, q) and np.array_equal(b, pi)
    rates = np.arange(18, dtype=float).reshape(2, 3, 3)
    rates[:, np.arange(3), np.arange(3)] = 0
    profile = dating.Profile(np.array([1.0, 4.0]), rates, np.arange(6, dtype=float).reshape(2, 3), rates * 2, [])
    stores.save_rates(profile, spark, f"{tmp_path}/rates")
    centers, q2, dwell, jumps = stores.load_rates(spark, f"{tmp_path}/rates")
    assert np.array_equal(centers, profile.centers) and np.array_equal(q2, rates) and np.array_equal(dwell, profile.dwell) and np.array_equal(jumps, profile.jumps)


def test_audits_and_ghosts_come_back(spark, tmp_path):
    told = spark.createDataFrame([(1, 0, 0.9, None, 0.9, True)], "node long, label int, agreement double, learned double, credibility double, is_anchor boolean")
    tracks = spark.createDataFrame([(1, 0.0, 9.0, 0.2, 0.8, "informative")], "sample long, left double, right double, p0 double, p1 double, status string")
    stores.save_audit(references.Audit(told, tracks, np.array([[-1.0, 1.0], [2.0, -2.0]])), f"{tmp_path}/audit")
    back = stores.load_audit(spark, f"{tmp_path}/audit")
    assert back.credibility.collect() == told.collect() and back.tracks.collect() == tracks.collect() and back.q[1, 0] == 2.0
    assert back.summary(["p0", "p1"], 18.0).first().foreign_share == 0.5
    found = ghosts.Ghosts(tracks, ghosts.Anchor(1.0, 0.5, 2.0, 2.5, 0.5), 3.0, 0.25, np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0.7, 0.3]), [-9.0, -8.0])
    stores.save_ghosts(found, f"{tmp_path}/ghosts")
    again = stores.load_ghosts(spark, f"{tmp_path}/ghosts")
    assert again.anchor == found.anchor and again.history == found.history and np.array_equal(again.transition, found.transition)
    assert again.burden().first().burden == 0.8
    stores.save_tracts(again.tracts(0.5), f"{tmp_path}/tracts")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/tracts").select("sample", "left", "right").collect()] == [(1, 0.0, 9.0)]


def test_labels_and_identifiers(spark, tmp_path):
    labels = spark.createDataFrame([("s1", "north"), ("s2", "south"), ("s3", "north")], "id string, label string")
    stores.write_labels(labels, f"{tmp_path}/labels")
    assert set(stores.read_labels(spark, f"{tmp_path}/labels").collect()) == set(labels.collect())
    states, names = stores.named_states(labels)
    assert {tuple(r) for r in states.collect()} == {("s1", 0), ("s2", 1), ("s3", 0)} and names.count() == 2
    (tmp_path / "ids").write_text("s1\n# a remark\n\n  s2 \ns1\n")
    assert {r.id for r in stores.read_ids(spark, f"{tmp_path}/ids").collect()} == {"s1", "s2"}
    samples = spark.createDataFrame([(0, "s1_1", "s1"), (1, "s1_2", "s1"), (2, "s2", "s2")], "node long, haplotype string, individual string")
    got = stores.resolve(spark.createDataFrame([("s1",), ("s2",), ("1",), ("nobody",)], "id string"), samples)
    assert {tuple(r) for r in got.collect()} == {("s1", 0), ("s1", 1), ("s2", 2), ("1", 1), ("nobody", None)}
