import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociflow.cluster import Stored
from lociflow.llm import bpe, langid, licenses, mixing, neardup, tiff, toxicity, urls, vectors

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def base_words(seed, n=60):
    rng = np.random.default_rng(seed)
    return [f"w{k}" for k in rng.integers(0, 400, n)]


def jaccard_groups(texts, percent=75):
    """(set size, smallest linked id) by brute force."""
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: grams(t) for i, t in texts}
    root = {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            same = len(sets[x] & sets[y])
            if x < y and same and 100 * same >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng, texts = np.random.default_rng(5), []
    for group in range(6):
        start = base_words(group)
        for _ in range(9):
            w = list(start)
            for k in rng.integers(0, len(w), rng.integers(0, 4)):
                w[k] = f"e{rng.integers(0, 50)}"
            texts.append(" ".join(w))
    texts += [None, "", "two words", "two words", " ".join(base_words(99, 20_000))]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_groups(rows)


def test_near_duplicates_keep_repeated_rows_and_null_ids(spark, empty):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True)], key=str)
    assert neardup.near_duplicates(empty).count() == 0


def mix_by_hand(rows):
    import hashlib
    import re

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: (1.0, 2.0, 3.0)[k % 3] for k, s in enumerate(sources)}
    capped = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        open_weight = sum(weight[s] for s in sources if s not in capped)
        goal = {s: 3.0 * total[s] if s in capped else left * weight[s] / open_weight for s in sources}
        over = {s for s in sources if s not in capped and goal[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    taken = {}
    for s in sources:
        budget = math.floor(goal[s] + 1e-9)
        own = sorted(((hashlib.md5(str(i).encode()).hexdigest(), i) for i, _, x in rows if x == s))
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        for _, i in own:
            part = max(0, min(size[i], rest))
            rest -= size[i] if rest > 0 else 0
            taken[i] = epochs * size[i] + part
    return taken, goal, total


def test_mixing_equals_brute_force(spark, empty):
    rows = [(i, " ".join(["w"] * (i % 7 * 3)), ["a", "b", "c", None][0 if i % 3 else i % 4]) for i in range(120)] + [(200, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df, range_rows=10).collect()}
    taken, goal, total = mix_by_hand(rows)
    assert {i: r.taken for i, r in got.items()} == taken
    for s in total:
        assert abs(sum(taken[i] for i, _, x in rows if x == s) - goal[s]) <= 1
    assert all(r.taken <= 3 * r.size for r in got.values())
    copies = {r.doc_id: r["count"] for r in mixing.repeated(df, range_rows=10).groupBy("doc_id").count().collect()}
    size = {i: r.size for i, r in got.items()}
    assert copies == {i: -(-t // size[i]) for i, t in taken.items() if t}
    assert mixing.mix(empty).count() == 0 and mixing.repeated(empty).count() == 0


def test_mixing_with_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "s", 9), (1, "a b", "s", 9), (2, "c", "s", 9)], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == 3 and sum(r.taken for r in got) == 5 and got[0].source_size == 5


def test_languages(spark, empty):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog are here", "en"), ("le chat et le chien sont ici", "fr"), ("der Hund und die Katze sind hier", "de")] * 10)]
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    asked = spark.createDataFrame([(1, "the dogs and the cats"), (2, "les chiens et les chats"), (3, None), (4, "12 34 !"), (5, ""), (6, "die Hunde und die Katzen " * 3000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(asked, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["en", "fr", "und", "und", "und", "de"] and got[3][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert langid.predict(asked, langid.fit(empty)).where("lang_pred = 'und'").count() == 6


def test_language_accuracy_on_held_out_rows(spark):
    from lociflow.llm.common import fold

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    got = langid.predict(docs.where(fold("doc_id", 3) == 1), langid.fit(docs.where(fold("doc_id", 3) != 1)))
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_toxicity(spark, empty):
    rows, labels = [], []
    for i in range(200):
        w = base_words(i, 40)
        if i % 4 == 0:
            w[5], w[9], w[30] = "slur", "insult", "slur"
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(i % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(7, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    asked = spark.createDataFrame([(1, "w1 w2 slur w3 insult w4"), (2, "w1 w2 w3"), (3, None), (4, ""), (5, "w7 " * 20_000), (1, "w1 w2 slur w3 insult w4")], "doc_id long, text string")
    got = sorted((r.doc_id, r.predicted) for r in toxicity.score(asked, model).collect())
    assert got == [(1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0)]
    found = toxicity.passages(asked, model).where("doc_id = 1").first().passage
    assert found.text.startswith("slur") and found.text.endswith("insult") and found.e_value <= toxicity.E_VALUE
    assert toxicity.score(empty, toxicity.fit(empty, marks)).count() == 0


def test_licences(spark, empty):
    long = "x " * 30_000 + "Released under the MIT License. " + "y " * 30_000
    rows = [(1, "a Licensed under the Apache License, Version 2.0. b"), (2, long), (3, None), (4, ""), (5, "released under the"), (1, "a Licensed under the Apache License, Version 2.0. b"), (6, "RELEASED\nunder  the MIT   license and " + licenses.TEMPLATES["GPL-notice"])]
    got = sorted((r.doc_id, r.license_id, r.containment) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "Apache-2.0", 1.0), (1, "Apache-2.0", 1.0), (2, "MIT", 1.0), (6, "GPL-notice", 1.0), (6, "MIT", 1.0)]
    assert licenses.scan(empty).count() == 0


def test_bpe_round_trip(spark, empty):
    df = spark.createDataFrame([(1, "Hello, wörld 12"), (2, None), (3, ""), (4, "a b " * 20_000)], "doc_id long, text string")
    coded = bpe.encode(df)
    want = bpe.coder(bpe.TOKENIZER).tokenizer
    for r in bpe.decode(coded).collect():
        ids = want.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == want.decode(ids, skip_special_tokens=False)
    assert bpe.digests(empty).count() == 0


def test_vectors_equal_brute_force(spark):
    rng, rows = np.random.default_rng(8), []
    for k in range(150):
        base = np.random.default_rng(k % 12).standard_normal(20)
        rows.append((k, (base + rng.normal(0, 0.12, 20)).tolist(), k % 2))
    rows += [(200, rows[0][1], 0), (201, [2 * x for x in rows[0][1]], 0), (202, None, 0), (203, [0.0] * 20, 0), (204, [float("nan")] + [1.0] * 19, 0), (205, [None] + [1.0] * 19, 0), (206, rows[0][1], None), (207, [1.0, 2.0], 0), (208, [1.0, 2.0], 0), (209, [], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16).collect()}
    ok = {i: np.array(v, float) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: y for i, _, y in rows}
    root = {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    count = dict.fromkeys(root, 0)
    for x in ok:
        for y in ok:
            if x < y and label[x] == label[y] and len(ok[x]) == len(ok[y]) and ok[x] @ ok[y] / np.linalg.norm(ok[x]) / np.linalg.norm(ok[y]) >= 0.98:
                count[x] += 1
                count[y] += 1
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    assert got == {i: (count[i], find(i)) for i in root} and sum(count.values()) > 50


def test_tiff_rows(spark, empty):
    df = spark.createDataFrame([(1, "hello"), (2, None), (3, "z" * 30_000)], "doc_id long, text string")
    pages = tiff.read_pages(tiff.encode_pages(df)).select("doc_id", "page.*").collect()
    for i, t in ((1, "hello"), (2, ""), (3, "z" * 30_000)):
        mine = sorted((r.page, bytes(r.pixels)) for r in pages if r.doc_id == i)
        assert b"".join(p for _, p in mine) == tiff.pad(t.encode())
    assert {r.compression for r in pages} == {tiff.DEFLATE, tiff.PACKBITS, tiff.LZW}
    broken = tiff.read_pages(spark.createDataFrame([(1, b"II*\0\xff\xff\0\0"), (2, None)], "doc_id long, media binary")).select("page.*").collect()
    assert len(broken) == 1 and broken[0].error
    good = tiff.write(tiff.pad(b"z" * 3000))
    ruined = []
    for tag in (256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325):
        for value in (0, 1, 0xFFFF):
            for dropped in (False, True):
                file, at = bytearray(good), int.from_bytes(good[4:8], "little")
                while at:
                    n = int.from_bytes(file[at : at + 2], "little")
                    for k in range(n):
                        place = at + 2 + 12 * k
                        if int.from_bytes(file[place : place + 2], "little") == tag:
                            file[place + 8 : place + 12] = value.to_bytes(4, "little")
                            if dropped:
                                file[place : place + 2] = (999).to_bytes(2, "little")
                    at = int.from_bytes(file[at + 2 + 12 * n : at + 6 + 12 * n], "little")
                ruined.append((len(ruined), bytes(file)))
    ruined += [(len(ruined) + k, good[:k]) for k in range(0, len(good), 37)]
    got = tiff.read_pages(spark.createDataFrame(ruined, "doc_id long, media binary")).select("doc_id", "page.*").collect()
    for i, file in ruined:
        mine = sorted((r.page, r.error, r.pixels) for r in got if r.doc_id == i)
        assert mine and all(e is None for _, e, _ in mine[:-1]) and all((p is None) == (e is not None) for _, e, p in mine)
    assert tiff.digests(empty).count() == 0 and tiff.digests(df).where("payload_bytes % 576 = 0").count() == 3
    twice = tiff.digests(df.union(df).withColumn("n_bytes", F.lit("old"))).collect()
    assert len(twice) == 6 and len({tuple(r)[1:] for r in twice}) == 3 and {r.n_bytes for r in twice} == {0, 5, 30_000}


def plain_pages(file):
    """A reader of its own for little-endian files of 8-bit grey pages: codes bit by bit, samples one by one."""
    import zlib

    number = lambda at, n: int.from_bytes(file[at : at + n], "little")

    def unpack(data, compression):
        if compression == 8:
            return zlib.decompress(data)
        out = bytearray()
        if compression == 32773:
            k = 0
            while k < len(data):
                n = data[k]
                if n < 128:
                    out += data[k + 1 : k + 2 + n]
                    k += n + 2
                else:
                    out += data[k + 1 : k + 2] * (257 - n) if n > 128 else b""
                    k += 2 if n > 128 else 1
            return bytes(out)
        bits = "".join(f"{b:08b}" for b in data)
        table, at, last = [], 0, None
        while True:
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
            code, at = int(bits[at : at + width], 2), at + width
            if code == 257:
                return bytes(out)
            if code == 256:
                table, last = [bytes([b]) for b in range(256)] + [b"", b""], None
                continue
            word = table[code] if code < len(table) else last + last[:1]
            out += word
            if last is not None:
                table.append(last + word[:1])
            last = word

    at, found = number(4, 4), []
    while at:
        tags = {}
        for k in range(number(at, 2)):
            place = at + 2 + 12 * k
            size = {3: 2, 4: 4}[number(place + 2, 2)]
            start = place + 8 if number(place + 4, 4) * size <= 4 else number(place + 8, 4)
            tags[number(place, 2)] = [number(start + size * j, size) for j in range(number(place + 4, 4))]
        width, height = tags[256][0], tags[257][0]
        w, h = (tags[322][0], tags[323][0]) if 322 in tags else (width, tags[278][0])
        pixels = [[0] * width for _ in range(height)]
        across = -(-width // w)
        for k, (begin, size) in enumerate(zip(tags[324 if 322 in tags else 273], tags[325 if 322 in tags else 279])):
            data = unpack(file[begin : begin + size], tags[259][0])
            for y in range(h):
                total = 0
                for x in range(w):
                    if y * w + x < len(data):
                        total = (total + data[y * w + x]) % 256 if tags[317][0] == 2 else data[y * w + x]
                        if k // across * h + y < height and k % across * w + x < width:
                            pixels[k // across * h + y][k % across * w + x] = total
        found.append(b"".join(map(bytes, pixels)))
        at = number(at + 2 + 12 * number(at, 2), 4)
    return found


def test_tiff_digests_equal_a_reader_of_its_own(spark):
    import hashlib
    import zlib

    texts = ["hello", None, "", "z" * 9000, "".join(chr(33 + k * k % 90) for k in range(12_000)), "wörter und mehr " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    media = {r.doc_id: bytes(r.media) for r in tiff.encode_pages(df).collect()}
    for r in tiff.digests(df).collect():
        data = (texts[r.doc_id] or "").encode()
        padded = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        back = b"".join(plain_pages(media[r.doc_id]))
        assert back == padded and r.n_bytes == len(data) and r.payload_bytes == len(padded)
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())
        assert r.feature.startswith(f"pages={-(-len(padded) // 2304)};mean={sum(padded) / len(padded):.4f};")


def test_tiff_codecs_by_known_codes():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.packbits_decode(packed, len(plain)) == plain
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    coded = int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(coded, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == coded


def test_urls(spark):
    rows = [(1, "https://Example.com/en/x?q=1"), (2, "https://www.example.com/en/x"), (3, "http://a.net/fr/"), (4, None), (5, "no scheme casino"), (6, "https://x.org/bonus-pills"), (7, "https://x.org/a?u=http://b.net/es/"), (8, "http://notexample.com/en/"), (1, "https://Example.com/en/x?q=1"), (9, "https://x.org/free-free-win"), (10, "https://x.org/" + "a/" * 100_000 + "xxx"), (11, ""), (None, "https://x.org/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got.pop(10)[3] == "block"
    assert got == {1: ("example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 3: ("a.net", "/fr/", "net/fr/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "block"), 6: ("x.org", "/bonus-pills", None, "block"), 7: ("x.org", "/a", None, "allow"), 8: ("notexample.com", "/en/", "com/", "allow"), 9: ("x.org", "/free-free-win", None, "allow"), 11: ("", "", None, "allow"), None: ("x.org", "/", None, "allow")}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    clash = urls.judge(spark.createDataFrame([("http://x.org/y", "old", 7)], "url string, host string, n_strict int"))
    assert sorted(clash.columns) == sorted({*clash.columns}) and (clash.first().host, clash.first().n_strict) == ("x.org", 0)


def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "toxicity", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "123 !!", "en", "src0", 6)], docs.schema))
    known = Stored(corpus_pipeline.known_language(spark, docs, "/root/testdata/sf0.001"), "t1").df
    left = {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()}
    assert {9001, 9002} <= left and len(left) <= 4 and known.columns == docs.columns
    unique = corpus_pipeline.deduplicated(spark, known, "").select("doc_id", "text").collect()
    groups = jaccard_groups([(r.doc_id, r.text) for r in known.select("doc_id", "text").collect()])
    assert {r.doc_id for r in unique} == {i for i, (_, c) in groups.items() if i == c}
    coded = corpus_pipeline.tokenized(spark, known.limit(20), "").collect()
    assert len(coded) == 20 and all(r.n_tokens == len(r.ids) for r in coded)
