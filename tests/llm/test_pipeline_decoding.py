import hashlib

import corpus_pipeline
from lociflow.llm import bpe


def test_pipeline_decodes_what_it_encodes(spark):
    rows = [(1, "en", "s", "Hello, wörld 12"), (2, None, "s", None), (3, "en", "s", "a b " * 20_000), (1, "en", "s", "Hello, wörld 12")]
    got = corpus_pipeline.tokenized(spark, spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"), "").collect()
    library = bpe.coder(bpe.TOKENIZER).tokenizer
    assert len(got) == 4
    for r in got:
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()
