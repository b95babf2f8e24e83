"""Byte-level BPE, filter audit and vector codes against the libraries and plain loops."""

import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from lociflow.llm import byte_bpe, codes, filters

ODD = ["", None, "a՘b ͸x  \n\n y", "  lead", "don't 'S 's''s", "x" * 5000, "日本語 テキスト 😀😀", "\x1c\x1d a\x85b   ", "𝟘12³ \U0001e9003", "tab\t\tend \n", "<|endoftext|>", "ꟍ꟎ \U00016d40 \U000105c0 a", "the same text", "the same text", " ", "\n"]


def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(), special_tokens={})


@pytest.fixture(scope="module")
def texts(spark):
    long = "so it goes, 12 times & more — " * 40_000  # over a megabyte
    rows = [(i, t, "x", "old") for i, t in enumerate([*ODD, long])]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, ids string").repartition(3)


def test_bytes_are_coded_as_by_the_library(texts):
    coder, want = library(), {r.doc_id: r.text or "" for r in texts.collect()}
    got = byte_bpe.encode(texts)
    assert sorted(got.columns) == ["block", "doc_id", "ids"]
    rows = byte_bpe.decode(got).collect()
    assert len(rows) == len(want) and all(r.block == "x" for r in rows)
    for r in rows:
        assert r.ids == coder.encode_ordinary(want[r.doc_id]) and bytes(r.decoded).decode() == want[r.doc_id]
    for r in byte_bpe.digests(texts.select("doc_id", "text")).collect():
        ids = coder.encode_ordinary(want[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_bytes_of_documents_and_of_no_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    coder, want = library(), {r.doc_id: r.text or "" for r in docs.collect()}
    got = byte_bpe.digests(docs).collect()
    assert len(got) == len(want)
    assert all(r.ids_sha256 == hashlib.sha256(np.array(coder.encode_ordinary(want[r.doc_id]), "<u4").tobytes()).hexdigest() for r in got)
    assert byte_bpe.digests(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert {r.n_tokens for r in byte_bpe.digests(empty).collect()} == {0}


def test_small_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    whole = {r.doc_id: r.ids for r in byte_bpe.encode(docs).collect()}
    run = byte_bpe._cut(pa.schema([("block", pa.int64()), ("rows", pa.list_(pa.struct([("c0", pa.int64())]))), ("slots", pa.binary()), ("first", pa.int32()), ("words", pa.list_(pa.string()))]))
    monkeypatch.setattr(byte_bpe, "BLOCK", 3000)
    monkeypatch.setattr(byte_bpe, "TOKENS", 100)
    monkeypatch.setattr(byte_bpe.TaskContext, "get", staticmethod(lambda: type("C", (), {"partitionId": lambda self: 2})()))
    rows = docs.collect()
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array([r.doc_id for r in rows])], ["c0"]), pa.array([r.text for r in rows])], ["row", "text"])
    words, coded, coder = {}, {}, byte_bpe._word_encoder(byte_bpe.VOCABULARY)
    made = list(run(iter([batch])))
    for b in made:
        for r in b.to_pylist():
            if r["words"] is not None:
                words.setdefault(r["block"], {}).update({r["first"] + i: w for i, w in enumerate(r["words"])})
    for b in made:
        for r in b.to_pylist():
            if r["rows"] is not None:
                n = byte_bpe._unpack(r["slots"]).tolist()
                at = n[0] + 1
                for row, size in zip(r["rows"], n[1 : n[0] + 1], strict=True):
                    coded[row["c0"]] = [i for s in n[at : at + size] for i in coder.encode_ordinary(words[r["block"]][s])]
                    at += size
    assert len(words) > 10 and coded == whole


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def test_transducer_equals_patterns():
    rng = np.random.default_rng(5)
    some = ["".join(rng.choice(list("aB C\tdé日😀#|x\n "), int(rng.integers(0, 60)))) for _ in range(300)]
    some += ["", "a", " a ", "longer-than-eight longer-than-eight longer-than-eighT " * 3, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + "y", "é" * 9]
    got = filters.transduce(pa.array([*some, None]))
    for i, t in enumerate([*some, ""]):
        assert tuple(int(got[c][i]) for c in filters._COUNTS) == plain(t), t


def test_hash_table_compares_bytes(monkeypatch):
    """With one hash for all spans only the comparison tells them apart."""
    monkeypatch.setattr(filters, "mix", lambda x: np.zeros_like(x))
    assert filters.transduce(pa.array(["a b a c longer-than-eight longer-than-eighT a", "b b"]))["n_distinct"].tolist() == [5, 1]


def audited(docs, labels):
    """(part, order, step) to the seven counts, by applying every order to the rows."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, part in docs:
        w, d, c, n, s = plain(text or "")
        fails = {f for f, x in zip("ABCDE", (w < 200, 100 * d < 50 * w, 100 * c > 3 * n, s > 0, i is not None and i > least[text or ""])) if x}
        rows.append((part or "", fails, labels.get(i, (0, 0))))
    out, shares = {}, {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                mine = [r for r in rows if r[0] == part and f in r[1]]
                out[part, "".join(order), k + 1] = (len(left), len(gone), len(mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2][0] == 1 for r in gone), sum(r[2][1] == 1 for r in gone))
                shares[part, f] = shares.get((part, f), 0) + len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_every_order_applied(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, long, "en"), (2, long, "en"), (3, None, None), (4, "", "de"), (2, long, "en"), (None, long, "fr"), (5, "A B # C", "en"), (6, "a a a a a", "de"), (7, long + " ABC DEF & " * 9, ""), (8, "a " * 300, "en")]
    labels = {1: (1, 0), 2: (0, 1), 4: (1, 1), 8: (0, 1)}
    df = spark.createDataFrame([(*d, "old") for d in docs], "doc_id long, text string, lang string, failed string")
    known = spark.createDataFrame([(i, *x) for i, x in labels.items()] + [(8, None, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filters.audit(df, known).collect()}
    assert got == audited(docs, labels) and len(got) == 600 * 4
    bare = filters.audit(df).where("good_lost + toxic_lost > 0")
    assert bare.count() == 0 and filters.audit(df.limit(0), known).count() == 0


def lloyd(rows):
    """(codes, errors, codebook) by comparing every part with every entry."""
    x = {i: [math.floor(256 * v) for v in vec] for i, vec in rows}
    d = len(next(iter(x.values())))
    ends = [k * d // 16 for k in range(17)]
    book = [x[i] for i in sorted(x)[:64]]
    cut = lambda v, p: v[ends[p] : ends[p + 1]]

    def assign():
        return {i: [min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(cut(v, p), cut(book[e], p))), e)) for p in range(16)] for i, v in x.items()}

    for _ in range(2):
        code, after = assign(), [list(b) for b in book]
        for p in range(16):
            for e in range(len(book)):
                mine = [cut(x[i], p) for i in x if code[i][p] == e]
                if mine:
                    after[e][ends[p] : ends[p + 1]] = [sum(c) // len(mine) for c in zip(*mine)]
        book = after
    code = assign()
    error = {i: sum(sum((a - b) ** 2 for a, b in zip(cut(v, p), cut(book[code[i][p]], p))) for p in range(16)) for i, v in x.items()}
    return code, error, book, ends


@pytest.mark.parametrize(("n", "d", "grain"), [(150, 32, 0.2), (90, 20, 3.0), (10, 16, 0.02)])
def test_codes_equal_every_comparison(spark, n, d, grain):
    rng = np.random.default_rng(n)
    vectors = [(int(i), (rng.standard_normal(d) * grain).astype(np.float32).tolist()) for i in rng.permutation(n)]
    vectors[3] = (vectors[3][0], vectors[4][1])  # ties
    odd = [(1000, None, 1), (1001, [float("nan")] * d, 1), (1002, [None] * d, 1), (1003, [float("inf")] * d, None), (1004, [0.5] * (d + 1), 1)]
    rows = [(i, v, int(i) % 3 if i % 5 else None, "old") for i, v in vectors] + [(*o, "old") for o in odd]
    got = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string").repartition(4)).collect()
    code, error, book, ends = lloyd(vectors)
    assert {r.vec_id: r.code for r in got} == {i: "".join(f"{c:02x}" for c in x) for i, x in code.items()}
    assert {r.vec_id: r.error for r in got} == error
    for r in got:
        assert r.label_error == sum(x.error for x in got if x.label == r.label)
    listed = ",".join(str(c) for a, b in itertools.pairwise(ends) for e in book for c in e[a:b])
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(listed.encode()).hexdigest()}


def test_codes_of_odd_tables(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    assert codes.compress(spark.createDataFrame([], kinds)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1)], kinds)).count() == 0
    same = codes.compress(spark.createDataFrame([(1, [0.25] * 16, 1), (1, [0.25] * 16, 1), (None, [0.25] * 16, None)], kinds)).collect()
    assert [(r.code, r.error) for r in same] == [("00" * 16, 0)] * 3
    book = np.arange(32).reshape(2, 16)
    back = codes.decode(spark.createDataFrame([("01" * 16,), (None,)], "code string"), book).collect()
    assert back[0].decoded == [x / 256 for x in range(16, 32)] and back[1].decoded is None


def test_few_entries_are_computed_exactly(spark):
    """Most entries are ruled out by their cells."""
    rng = np.random.default_rng(0)
    book = codes.Book((rng.standard_normal((64, 4)) * 32).astype(np.int64))
    x = (rng.standard_normal((5000, 4)) * 32).astype(np.int64)
    code, error = book.nearest(x)
    every = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all() and book.computed < 0.5 * every.size
