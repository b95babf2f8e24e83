"""Bands of the licence scan against plain containment: edited and scattered templates, both join paths, odd columns."""

import random
import re

import pytest

from lociflow.llm import licenses


def grams(text):
    words = [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (text or "").lower()) if w]
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)}


def plain(rows, templates):
    sets = {k: grams(t) for k, t in templates.items()}
    return sorted((i, k, len(s), len(s & grams(t))) for i, t in rows for k, s in sets.items() if s and 100 * len(s & grams(t)) >= 75 * len(s))


def documents():
    rng = random.Random(4)
    noise = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    rows = []
    for i in range(300):
        words = rng.choice(sorted(licenses.TEMPLATES.values())).split()
        kind = i % 4
        if kind == 1:  # a few words changed
            for k in rng.sample(range(len(words)), max(0, len(words) // rng.choice([12, 25, 40]))):
                words[k] = "changed"
        parts = [" ".join(words)]
        if kind == 2:  # cut apart, far from one another
            size = rng.choice([9, 20, 30])
            parts = [" ".join(words[k : k + size + 4]) for k in range(0, len(words), size)]
            rng.shuffle(parts)
        if kind == 3:  # the head only
            parts = [" ".join(words[: int(len(words) * rng.uniform(0.6, 0.95))])]
        rows.append((i, " ".join(noise(rng.randrange(60)) + " " + p for p in parts) + " " + noise(rng.randrange(400))))
    return rows + [(7, None), (8, ""), (9, rows[0][1]), (9, rows[0][1]), (None, rows[4][1]), (None, "nothing here at all")]


@pytest.mark.parametrize("limit", [licenses.FEW_CHARACTERS, 0])
def test_equals_plain_containment(spark, monkeypatch, limit):
    monkeypatch.setattr(licenses, "FEW_CHARACTERS", limit)
    rows = documents()
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: tuple((x is None, x or 0) for x in r[:1]) + r[1:]
    want = sorted(((i, k, n, m) for i, t in rows for _, k, n, m in plain([(0, t)], licenses.TEMPLATES)), key=key)
    assert len(want) > 200
    assert sorted(((r.doc_id, r.license_id, r.n_shingles, r.n_matched) for r in got.collect()), key=key) == want


def test_names_that_clash(spark):
    row = ("a", "Released under the MIT License.", 1, 2)
    got = licenses.scan(spark.createDataFrame([row], "license_id string, text string, words int, row int"), id_col="license_id").collect()
    assert [(r.license_id_in, r.license_id) for r in got] == [("a", "MIT")]
