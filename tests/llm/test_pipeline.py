import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociflow.llm import bpe, mixing
from test_operators import jaccard_groups, mix_by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    read = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, "en", "src0", 0), (9002, "123 !!", "en", "src0", 6), (None, "the rein that of the and this was not", "en", "src1", 30), (9003, "", None, None, 0)]
    return read.unionByName(spark.createDataFrame(odd, read.schema))


@pytest.fixture(scope="module")
def steps(spark, docs):
    """What each stage but the last makes of the stage before, all in memory."""
    found, now = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        found.append(now)
    return found


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_language_stage_keeps_clean_documents(docs, steps):
    left = rows(docs) - rows(steps[0])
    assert {r[0] for r in left} >= {9001, 9002, 9003} and sum(left.values()) <= 6
    assert not rows(steps[0]) - rows(docs)


def test_toxicity_stage_drops_the_toxic(spark, steps):
    assert not rows(steps[1]) - rows(steps[0])
    sf = "/root/testdata/sf0.01"  # the smallest table has too few toxic documents to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    told = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.not_toxic(spark, docs, sf).collect()}
    toxic, clean = ({r.doc_id for r in docs.collect() if told.get(r.doc_id) == y} for y in (1, 0))
    assert len(clean - kept) <= 0.02 * len(clean) and len(toxic - kept) >= 0.5 * len(toxic)


def test_dedup_stage_equals_brute_force(spark, steps):
    want = jaccard_groups([(k, r.text) for k, r in enumerate(sorted(steps[1].collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)))])
    assert steps[2].count() == sum(i == c for i, (_, c) in want.items())
    ids = {i: (_n, c) for i, (_n, c) in jaccard_groups([(r.doc_id, r.text) for r in steps[1].collect() if r.doc_id is not None]).items()}
    assert {r.doc_id for r in steps[2].collect() if r.doc_id is not None} == {i for i, (_, c) in ids.items() if i == c}


def test_dedup_stage_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    made = [(5, text), (5, text), (None, text), (3, text + " more"), (None, "a b c d e f g"), (None, "a b c d e f g"), (7, "other words stand here so"), (7, "and other words stand there so"), (8, None), (None, "")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in made], "doc_id long, text string, n long, kept string")
    got = corpus_pipeline.deduplicated(spark, df, "")
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text, r.kept) for r in got.collect()) == Counter([(3, text + " more", "x"), (None, "a b c d e f g", "x"), (7, "other words stand here so", "x"), (7, "and other words stand there so", "x"), (8, None, "x"), (None, "", "x")])


def test_mixing_stage_equals_brute_force(steps):
    known = [(r.doc_id, r.text, r.source) for r in steps[2].collect() if r.doc_id is not None]
    taken, _, _ = mix_by_hand(known)
    size = {i: len((t or "").split()) for i, t, _ in known}
    if all(r.doc_id is not None for r in steps[2].collect()):
        assert Counter(r.doc_id for r in steps[3].collect()) == Counter({i: math.ceil(t / size[i]) for i, t in taken.items() if t})


def test_last_stage_and_run(spark, docs, steps):
    library = bpe.coder(bpe.TOKENIZER).tokenizer

    def coded(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    last = corpus_pipeline.tokenized(spark, steps[3], SF).collect()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in last) == Counter((r.doc_id, *coded(r.text)) for r in steps[3].collect())
    now = spark.read.parquet(f"{SF}/documents.parquet")
    schema = now.schema
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), schema)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in whole) == Counter((r.doc_id, coded(r.text)[0], coded(r.text)[2]) for r in now.collect())


def test_empty_tables_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, score string, size int, lang_pred string, predicted string"
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    few = spark.createDataFrame([(k, f"the thing that was of this and the {w} here", "en", "s", "kept", 7, "old", "old") for k, w in enumerate(["ore", "ing", "tion", "ent"])], schema)
    now = few
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == few.columns
        assert all((r.score, r.size, r.lang_pred, r.predicted) == ("kept", 7, "old", "old") for r in now.collect())
    assert mixing.mix(few).columns.count("size") == 1 and now.select(F.max("doc_id")).first()[0] is not None
