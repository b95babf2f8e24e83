import itertools
import math
import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lociflow.llm import bpe, lm, neardup, tiff, toxicity, urls, vectors
from lociflow.llm.text import Words, buffers, shingles, slices

TEXTS = ["  Ab c\n", None, "", "x", "a b c d e f a b c d e", " ", "É ÀB\tc\x0bd", "one two three four", "Z" * 5000 + " q"]


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def test_words_and_hashes():
    w = Words(pa.array(TEXTS))
    assert w.column(np.arange(len(w))).to_pylist() == [x for t in TEXTS for x in words(t)]
    assert w.counts.tolist() == [len(words(t)) for t in TEXTS]
    assert len(set(w.hashes().tolist())) == len({x for t in TEXTS for x in words(t)})
    part = pa.array(TEXTS).slice(3, 4)
    assert Words(part).counts.tolist() == [len(words(t)) for t in TEXTS[3:7]] and buffers(part)[1][0] == 0


def test_shingles():
    h, owner = shingles(Words(pa.array(TEXTS)))
    for i, t in enumerate(TEXTS):
        ws = words(t)
        want = len({tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}) if len(ws) >= 5 else int(bool(ws))
        assert (owner == i).sum() == want
    assert all(b > a for (_, a), (_, b) in itertools.pairwise([(0, -1), *slices(pa.array(TEXTS), 4)]))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:850], rng.integers(0, 2**63, 150, dtype=np.uint64)])
    s = neardup.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 850 / 1150) < 0.1
    assert (neardup.band_keys(s)[0] == neardup.band_keys(s)[1]).any()


def naive_segments(scores, offset=0):
    """All maximal segments from the definition: the best one, then what is left and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    i = -best[2]
    j = i - best[1]
    return naive_segments(scores[:i], offset) + [(offset + i, offset + j)] + naive_segments(scores[j:], offset + j)


def test_maximal_segments():
    random.seed(3)
    assert [(a, b) for a, b, _ in toxicity.maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5])] == [(0, 1), (2, 3), (4, 11)]
    for _ in range(300):
        scores = [random.choice([-3.1, -1.07, -0.53, 0.71, 2.29, 4.17]) + random.random() / 100 for _ in range(random.randint(0, 12))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(scores)] == naive_segments(scores)


def test_maximal_segments_take_linear_time():
    """Words that score up and down by turns: half a million candidates that no search may pass again and again."""
    import time

    for scores in ([1.0, -2.0] * 500_000, [1.0, -0.5] * 500_000, [3.0, -1.0, 1.0, -3.0] * 250_000):
        began = time.perf_counter()
        found = toxicity.maximal_segments(scores)
        assert time.perf_counter() - began < 10 and found
    assert len(toxicity.maximal_segments([1.0, -2.0] * 500_000)) == 500_000


def test_prefix_code_is_complete():
    code = lm.CODE
    assert math.isclose(sum(2.0 ** -n for n in code.length), 1.0)
    assert len({tuple(code.bits[b, : code.length[b]]) for b in range(256)}) == 256


def blank_model():
    empty = np.zeros(0, np.uint64)
    return lm.Model(np.zeros(lm._BASES[-1], np.int8), np.zeros(lm._BEFORE[-1], np.int8), empty, empty.astype(np.int64), pa.array([], pa.string()), 0, 0, 0)


def test_even_bits_give_known_probability():
    got = lm.log_probabilities(lm.Tokens(Words(pa.array(["ab", None]))), blank_model())
    bits = sum(int(lm.CODE.length[ord(c)]) for c in "ab ")
    assert len(got) == 3 and np.isclose(got[0], bits * math.log(0.5) + math.log1p(-0.05), atol=1e-3)


def test_repetition_gets_likelier():
    same = lm.log_probabilities(lm.Tokens(Words(pa.array([" ".join(["abc"] * 40)]))), blank_model())
    assert same[-2] > same[0] + 5


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(bpe.TOKENIZER)


def test_bpe_equals_the_library(coder):
    odd = [None, "", " \n ", "foo ́bar", "<|endoftext|> x<|ENDOFTEXT|>y", "it's 's don't 12 34　x", "e ́ ́ x", "́a b", "İstanbul ΑΣ b", "x" * 5000 + " y", "\x0b\x0c a\x1cb\x85c d", "same words same words same words"]
    want = []
    for t in odd:
        e = coder.tokenizer.encode(t or "", add_special_tokens=False)
        want.append((np.array(e.ids, "<u4").tobytes(), coder.tokenizer.decode(e.ids, skip_special_tokens=False).encode()))
    assert coder.texts(pa.array(odd)) == want
    assert coder.texts(pa.array(odd)) == want  # from memory


def test_bpe_chunks_are_shared_across_texts():
    own, rng = bpe.Coder(), random.Random(6)
    passage = " ".join("".join(rng.choice("abcdeéß'1.") for _ in range(rng.randint(1, 9))) for _ in range(400))
    texts = [f"{k} other {'words ' * k}{passage} end {k * k}" for k in range(12)]
    for t in texts:
        (ids, decoded), = own.texts(pa.array([t]))
        want = own.tokenizer.encode(t, add_special_tokens=False).ids
        assert ids == np.array(want, "<u4").tobytes() and decoded.decode() == own.tokenizer.decode(want, skip_special_tokens=False)
    chunks = int(bpe._cuts(Words(pa.array([passage])), *buffers(pa.array([passage])))[1].sum())
    assert 12 <= chunks <= 60  # some sixteen words each
    assert own.reused >= 0.8 * chunks * (len(texts) - 3)


def test_bpe_reads_the_sign_between_pieces_as_text(coder):
    texts = ["a \x01 b", "\x01", "x\x01y \x01\x01 z", " ".join(f"w{k} \x01" for k in range(300)), "plain words"]
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.texts(pa.array(texts)) == [(np.array(i, "<u4").tobytes(), coder.tokenizer.decode(i, skip_special_tokens=False).encode()) for i in want]


def test_bpe_keeps_little_of_a_piece():
    """A worker's memory: a piece is kept with its ids alone, under 250 bytes each with its place in the table."""
    own, texts = bpe.Coder(), pa.array([" ".join(f"q{k * 7919 % 1_000_003:x}z" for k in range(i, i + 500)) for i in range(0, 40_000, 500)])
    tracemalloc.start()
    try:
        own.texts(texts)
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(own.known) > 30_000 and kept < 250 * len(own.known)


def test_bpe_repairs_until_the_pieces_agree(coder, monkeypatch):
    """A tokenizer that reads a mark together with both words before it: the repair goes on past the first join."""
    data = "ab cd \u0301x yz".encode()
    starts, ends = np.array([0, 3, 6, 10]), np.array([2, 5, 9, 12])
    monkeypatch.setattr(coder, "agree", lambda left, gap, right: b"\xcc\x81" not in right)
    coder._repair(data, starts, ends, 2, 0)
    assert [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())] == ["ab cd \u0301x".encode(), b"", b"", b"yz"]


def test_code_bounds_hold():
    x = vectors.unit(np.random.default_rng(2).standard_normal((300, 50)))
    codes, i, j = vectors.Codes(x), *np.triu_indices(300, 1)
    exact = np.einsum("ij,ij->i", x[i], x[j])
    assert (codes.bound(i, j) >= exact - 1e-9).all()
    assert abs((codes.estimate(i, j)[1] - exact).mean()) < 0.01
    near = vectors.unit(x + 0.02 * np.random.default_rng(3).standard_normal(x.shape))
    shared = (vectors.band_bits(x) == vectors.band_bits(near)).any(axis=1)
    assert shared.all()


@pytest.mark.parametrize("n", [0, 1, 5, 300, 3000, 70_000])
def test_tiff_codecs(n):
    random.seed(n)
    for data in (os.urandom(n), bytes(random.choice(b"ab ") for _ in range(n)), b"z" * n):
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
        padded = tiff.pad(data)
        assert len(padded) % 576 == 0 and b"".join(p.pixels.tobytes() for p in tiff.pages(tiff.write(padded))) == padded


def test_big_endian_colour_page():
    import struct

    rows = bytes(range(24))
    tags = [(256, 3, 1, 4 << 16), (257, 3, 1, 2 << 16), (258, 3, 3, 0), (259, 3, 1, 1 << 16), (262, 3, 1, 2 << 16), (273, 4, 1, 8), (277, 3, 1, 3 << 16), (278, 3, 1, 2 << 16), (279, 4, 1, 24)]
    at = 8 + 24
    bits = at + 2 + 12 * len(tags) + 4
    tags[2] = (258, 3, 3, bits)
    file = b"MM\0*" + struct.pack(">I", at) + rows + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0\0\0\0" + struct.pack(">3H", 8, 8, 8)
    (page,) = tiff.pages(file)
    assert (page.width, page.height, page.samples) == (4, 2, 3) and page.pixels.tobytes() == rows
    with pytest.raises(ValueError):
        list(tiff.pages(b"no"))


def test_url_terms():
    found = urls.automaton()
    assert urls.hits("http://a/Spam-Farm.x", found)[0] == {"spam-farm"}
    assert urls.hits("http://freedom.x/betsy", found) == (set(), {}) and urls.hits(None, found) == (set(), {})
    assert urls.hits("http://x/free_bonus?free", found)[1] == {"free": 1, "bonus": 2}
    assert max(urls.SOFT.values()) < urls.SOFT_LIMIT and not set(urls.STRICT) & set(urls.SOFT)


def test_url_terms_equal_brute_force():
    import re

    rng, found = random.Random(4), urls.automaton()
    terms = [*urls.STRICT, *urls.SOFT, "x", "é", "9", "casinos2"]
    for _ in range(500):
        url = "".join(rng.choice(terms) + rng.choice(["", "/", "-", "_", "É", ".", "a"]) for _ in range(rng.randint(0, 8)))
        edge = lambda t: re.search(r"(?<![^\W_])" + re.escape(t) + r"(?![^\W_])", url.lower())
        strict, soft = urls.hits(url, found)
        assert strict == {t for t in urls.STRICT if edge(t)} and soft == {t: w for t, w in urls.SOFT.items() if edge(t)}, url
