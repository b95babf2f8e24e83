"""Nulls, repeats, ties, empty tables, long texts and clashing names, operator by operator where the other tests leave them out."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociflow.llm import bpe, langid, licenses, mixing, neardup, tiff, toxicity, vectors

CLASH = "doc_id long, text string, lang string, source string, score string, lang_pred string, predicted string, n_tokens string, media_bytes string, component_id string, license_id string, size string"
TEXT = "the cat and the dog are here with the bird and so on"


@pytest.fixture(scope="module")
def odd(spark):
    tail = ["old"] * 8
    return spark.createDataFrame([(1, TEXT, "en", "s", *tail), (1, TEXT, "en", "s", *tail), (None, TEXT, "en", None, *tail), (2, None, None, "s", *tail), (3, "", "en", "s", *tail), (None, None, None, None, *tail)], CLASH)


def alike(rows, key="text"):
    """Rows of equal texts have equal results."""
    found = {}
    for r in rows:
        found.setdefault(r[key], set()).add(tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "source", "lang")))
    assert all(len(v) == 1 for v in found.values())


def test_language_id(odd):
    got = langid.predict(odd, langid.fit(odd))
    rows = got.collect()
    assert len(rows) == 6 and len(set(got.columns)) == len(got.columns)
    assert Counter(r.lang_pred for r in rows) == Counter({"en": 3, "und": 3}) and {r.score for r in rows if r.lang_pred == "und"} == {0.0}
    alike(rows)


def test_language_vectors_equal_their_definition():
    """Letters bound with shifts, n-grams summed, cosine with the sum of unit vectors: letter by letter."""
    texts = ["Ab, cab!", "ba", "", "12", None, "äb Cd"]
    vectors_of, has = langid.bundles(pa.array(texts))
    gap = langid._letter_vector(0).astype(int)
    for i, t in enumerate(texts):
        letters = []
        for c in (t or "").lower():
            if c.isalpha():
                letters.append(ord(c))
            elif not letters or letters[-1] != 0:
                letters.append(0)
        # a text stands between gaps
        line = ([] if letters[:1] == [0] else [0]) + letters + ([] if letters[-1:] == [0] else [0])
        want = np.zeros(langid.DIMENSIONS, int)
        for k in range(len(line) - 2):
            if line[k + 1]:  # around a letter
                gram = [gap if c == 0 else langid._letter_vector(c).astype(int) for c in line[k : k + 3]]
                want += gram[0] * np.roll(gram[1], 1) * np.roll(gram[2], 2)
        assert has[i] == any(line)
        if any(line):
            cosine = want @ vectors_of[i] / np.linalg.norm(want) / np.linalg.norm(vectors_of[i])
            assert cosine > 0.999


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.fit(odd, labels))
    rows = got.collect()
    assert len(rows) == 6 and len(set(got.columns)) == len(got.columns) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    alike(rows)


def test_toxicity_scores_equal_the_formula(spark):
    """The curve over a text's evidence, with segments by the definition, for a given model."""
    import math

    model = toxicity.Model({"bad": 2.0, "worse": 3.5, "fine": -1.0}, 0.8, 0.05, (-3.0, 0.4, 0.5, 0.3, 0.7))
    texts = ["a bad day", "bad worse fine bad", "nothing here", "", None, "worse " * 50]
    got = {r.i: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        scores = [model.scores.get(w, -toxicity.DRIFT) for w in words]
        rest, found = [(0, len(scores))], []
        while rest:
            a, b = rest.pop()
            best = max(((sum(scores[x:y]), -(y - x), -x) for x in range(a, b) for y in range(x + 1, b + 1)), default=(0, 0, 0)) if b - a <= 60 else (0, 0, 0)
            if best[0] > 1e-12:
                x = -best[2]
                y = x - best[1]
                found.append(best[0])
                rest += [(a, x), (y, b)]
        gains = [max(0.0, model.rate * s - math.log(model.scale * len(words))) for s in found]
        x = [1.0, math.log1p(max(gains, default=0)), math.log1p(sum(gains)), math.log1p(sum(found)), math.log1p(len({w for w in words if model.scores.get(w, -1) > 0}))]
        assert abs(got[i] - 1 / (1 + math.exp(-sum(w * v for w, v in zip(model.weights, x))))) < 1e-9, t


def test_near_duplicates(odd):
    got = neardup.near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == 6 and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter({(1, 1): 2, (None, 1): 1, (2, 2): 1, (3, 3): 1, (None, None): 1})


def test_mixing_of_long_texts_and_nulls(spark, odd):
    got = mixing.mix(odd)
    assert got.count() == 6 and got.columns.count("size") == 1
    long = spark.createDataFrame([(1, "w " * 200_000, "a"), (2, "w", "b"), (2, "w", "b")], "doc_id long, text string, source string")
    rows = mixing.mix(long).collect()
    assert {r.size for r in rows} == {200_000, 1} and all(r.taken <= 3 * r.size for r in rows) and sum(r.taken for r in rows if r.source == "b") == 6


def test_bpe(odd):
    got = bpe.digests(odd)
    rows = got.collect()
    assert len(rows) == 6 and len(set(got.columns)) == len(got.columns)
    assert {r.n_tokens for r in rows if not r.text} == {0} and {r.decoded_sha256 for r in rows if not r.text} == {hashlib.sha256(b"").hexdigest()}
    alike(rows)


def test_tiff(odd):
    got = tiff.digests(odd)
    rows = got.collect()
    assert len(rows) == 6 and len(set(got.columns)) == len(got.columns) and {r.n_bytes for r in rows} == {0, len(TEXT)} and {r.payload_bytes for r in rows} == {576}
    pages = tiff.read_pages(tiff.encode_pages(odd.withColumn("page", F.lit("old"))))
    assert pages.columns.count("page") == 1 and pages.count() == 6


def test_licences_with_clashing_names(spark, odd):
    more = odd.withColumn("text", F.when(F.col("doc_id") == 1, F.lit("x released under the mit license y")).otherwise(F.col("text")))
    got = licenses.scan(more)
    assert got.columns == ["doc_id", "license_id", "n_shingles", "n_matched", "containment"] and [tuple(r)[:2] for r in got.collect()] == [(1, "MIT"), (1, "MIT")]


def test_licence_windows_miss_nothing(spark):
    """Every template inside random words, at every place in a window: all are found, and nothing else."""
    rng, rows, want = np.random.default_rng(12), [], set()
    for k, (name, body) in enumerate(sorted(licenses.TEMPLATES.items())):
        for ahead in range(0, 24, 3):
            i = 100 * k + ahead
            rows.append((i, " ".join([*(f"v{x}" for x in rng.integers(0, 10**9, ahead)), body, *(f"v{x}" for x in rng.integers(0, 10**9, 40 - ahead))])))
            want.add((i, name))
    got = {(r.doc_id, r.license_id) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got


def test_vectors(spark):
    v = [1.0, 2.0, 3.0]
    schema = "vec_id long, embedding array<double>, label int, n_links string, component_id string"
    df = spark.createDataFrame([(1, v, 0, "old", "old"), (1, v, 0, "old", "old"), (None, v, 0, "old", "old"), (2, v, 1, "old", "old"), (3, None, 0, "old", "old")], schema)
    got = vectors.near_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == Counter({(1, 2, 1): 2, (None, 2, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1})
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    long = spark.createDataFrame([(k, [float(k % 2 + 1)] * 5000 + [float(k)], 0) for k in range(4)], "vec_id long, embedding array<double>, label int")
    assert {r.component_id for r in vectors.near_duplicates(long).collect()} == {0}


def test_hubs_are_split(spark):
    from lociflow.llm.components import connected_components

    rng = np.random.default_rng(4)
    edges = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(40)] + [(7000, 7000), (None, 1)] + [(int(a), int(b)) for a, b in rng.integers(9000, 9100, (60, 2))]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root}
