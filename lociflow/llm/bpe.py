"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of the bytes before each gap between words decides where a text is cut, on two scales: chunks of some sixteen words, and
inside them pieces of one or few words. Equal passages of different texts give equal chunks. A worker keeps the chunks it has met more than
once and takes their ids from memory; the other chunks are put together from their pieces, each of which is encoded once and kept too.
Where two pieces meet in a way that could read differently together (a mark that combines with what stands before it), both are encoded
again as one, and so on towards the start of the text until the pieces agree exactly with what they give together. The
tokenizer drops white space, so all other joins are exact.

What a worker keeps is bounded: pieces and chunks of two generations each, forgotten at a task's end, and a table of fixed size that
tells what was met before. Null and empty texts have no ids and decode to the empty string. Special tokens written in a text are read as the library
reads them. A text without gaps is one chunk; texts of any length are read whole. Rows are neither added nor dropped, repeated rows are
coded alike, ties can't arise; empty tables give empty results. Input columns named like a new column are replaced.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lociflow.llm.common import with_text_udf
from lociflow.llm.text import Words, buffers, ranges, slices

TOKENIZER = "word_bpe_49k.json"
#: Bytes that the rolling hash sees; a gap is no cut of pieces where its lowest KEEP_BITS bits are 0, and one of chunks where
#: also the next CHUNK_BITS bits are 0.
WINDOW, KEEP_BITS, CHUNK_BITS = 6, 6, 4
#: Pieces and chunks of a generation (a worker keeps two); bits (as a power of two) of the table of chunks met; pieces encoded together, and
#: how many such groups in one call; chunks put together, and tokens spelled, at once.
PIECES, CHUNKS, MET_POWER, TOGETHER, GROUPS, BLOCK = 50_000, 10_000, 25, 256, 8, 1 << 14
#: Stands between pieces that are encoded together: one token, which nothing else gives.
APART = "\x01"
#: Ids decoded in one call; a longer text is decoded alone.
DECODED = 1 << 16
_TABLE = np.random.default_rng(606).integers(0, 2**32, (WINDOW, 256), dtype=np.uint32)


class Coder:
    """One worker's tokenizer and the pieces and chunks it has encoded."""

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(name)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.apart = self.tokenizer.encode(APART, add_special_tokens=False).ids
        words = [f"{self.tokenizer.id_to_token(i)} ".encode() for i in range(self.tokenizer.get_vocab_size())]
        self.letters = np.frombuffer(b"".join(words), np.uint8)  # all tokens, a space behind each
        self.lengths = np.array([len(w) for w in words], np.int32)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.shared: dict[bytes, bytes] = {}
        self.passed: dict[bytes, bytes] = {}
        self.met = bytearray(1 << (MET_POWER - 3))
        self.reused = 0

    def forget(self) -> None:
        """Drop all pieces and chunks."""
        self.known, self.older, self.shared, self.passed = {}, {}, {}, {}

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """The ids, as little-endian 32-bit integers, of each chunk."""
        out: list[bytes] = []
        # many short chunks in one text, apart by line ends, which the tokenizer drops, and a sign whose token tells where each begins
        groups = [[c.decode("utf-8", "replace") for c in chunks[i : i + TOGETHER]] for i in range(0, len(chunks), TOGETHER)]
        between = f"\n{APART}\n"
        for i in range(0, len(groups), GROUPS):
            some = groups[i : i + GROUPS]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([between.join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                data, at = ids.tobytes(), np.flatnonzero(ids == self.apart[0])
                if len(at) == len(group) - 1:
                    begins, ends = [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(data)]
                    out += [data[a:b] for a, b in zip(begins, ends, strict=True)]
                else:  # a text holds the sign itself
                    out += [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
        return out

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of the distinct pieces. Once a generation is full, only what is used again outlives the next."""
        if len(self.known) > PIECES:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = [known.get(p) for p in pieces]
        missing = [k for k, got in enumerate(out) if got is None]
        for k in missing:
            out[k] = older.get(pieces[k])
        new = [k for k in missing if out[k] is None]
        for k, ids in zip(new, self._encode([pieces[k] for k in new]), strict=True):
            out[k] = ids
        known.update((pieces[k], out[k]) for k in missing)
        return out

    def agree(self, left: bytes, gap: bytes, right: bytes) -> bool:
        apart, joined = self._encode([left, right]), self._encode([left + gap + right])[0]
        return apart[0] + apart[1] == joined

    def _keep(self, key: bytes, made: bytes) -> None:
        """Keep a chunk from the second time on."""
        spot = hash(key) & ((1 << MET_POWER) - 1)
        if self.met[spot >> 3] >> (spot & 7) & 1:
            if len(self.shared) > CHUNKS:
                self.shared, self.passed = {}, self.shared
            self.shared[key] = made
        else:
            self.met[spot >> 3] |= 1 << (spot & 7)

    def _chunks(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The ids of chunks: of each, the pieces from begin on, so many."""
        at = ranges(begin, count)
        sizes = ends[at] - starts[at]
        offs = np.concatenate([[0], np.cumsum(sizes)])
        column = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offs), pa.py_buffer(raw[ranges(starts[at], sizes)])])
        coded = column.dictionary_encode()
        which, found = coded.indices.to_numpy(), self.learn(coded.dictionary.to_pylist())
        length = np.array([len(f) >> 2 for f in found], np.int64)
        tokens = np.frombuffer(b"".join(found), "<u4")[ranges((np.cumsum(length) - length)[which], length[which])].tobytes()
        until = 4 * np.concatenate([[0], np.cumsum(length[which])])[np.concatenate([[0], np.cumsum(count)])]
        return [tokens[a:b] for a, b in zip(until[:-1].tolist(), until[1:].tolist(), strict=True)]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; see _encode."""
        words, (raw, offs) = Words(texts), buffers(texts)
        cut, far = _cuts(words, raw, offs)
        data = raw.tobytes()
        starts = words.starts[cut]
        ends = words.ends[np.append(np.flatnonzero(cut)[1:], len(words)) - 1] if len(starts) else starts
        floor = np.searchsorted(starts, offs)
        for k in np.flatnonzero(raw[starts] >= 0xCC) if len(starts) else ():
            self._repair(data, starts, ends, int(k), int(floor[np.searchsorted(floor, k, side="right") - 1]))
        first = np.flatnonzero(far[cut])
        borders = np.append(first, len(starts))
        begin, end = starts[first].tolist(), ends[borders[1:] - 1].tolist() if len(first) else []
        keys = [data[a:b] for a, b in zip(begin, end, strict=True)]
        shared, passed = self.shared, self.passed
        made = [shared.get(key) or passed.get(key) for key in keys]
        missing = np.array([k for k, got in enumerate(made) if got is None], np.int64)
        self.reused += len(made) - len(missing)
        for i in range(0, len(missing), BLOCK):
            some = missing[i : i + BLOCK]
            for k, got in zip(some.tolist(), self._chunks(raw, starts, ends, borders[some], borders[some + 1] - borders[some]), strict=True):
                made[k] = got
                self._keep(keys[k], got)
        of = np.searchsorted(starts[first], offs).tolist() if len(first) else [0] * len(offs)
        return [b"".join(made[a:b]) for a, b in zip(of[:-1], of[1:], strict=True)]

    def decoded(self, ids: list[bytes]) -> list[bytes]:
        """The tokens of each text, apart by spaces."""
        tokens, parts, size = np.frombuffer(b"".join(ids), "<u4"), [], np.zeros(1, np.int64)
        until = np.cumsum([0, *(len(i) >> 2 for i in ids)])
        for i in range(0, len(tokens), 8 * BLOCK):
            some = tokens[i : i + 8 * BLOCK]
            parts.append(self.letters[ranges(self.begins[some], self.lengths[some])].tobytes())
        if len(tokens):
            size = np.concatenate([size, np.cumsum(self.lengths[tokens], dtype=np.int64)])
        data, ends = b"".join(parts), size[until].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def texts(self, texts: pa.Array) -> list[tuple[bytes, bytes]]:
        """(ids, decoded text) of each text."""
        ids = self.ids(texts)
        return list(zip(ids, self.decoded(ids), strict=True))

    def _repair(self, data: bytes, starts: np.ndarray, ends: np.ndarray, k: int, floor: int) -> None:
        """Join piece k to the one before while they read differently together; a piece joined is left empty."""
        text = data[starts[k] : ends[k]].decode("utf-8", "replace")[:1]
        if not text or unicodedata.category(text)[0] != "M":
            return
        while k > floor:
            j = k - 1
            while j > floor and starts[j] == ends[j]:
                j -= 1
            if starts[j] == ends[j] or self.agree(data[starts[j] : ends[j]], data[ends[j] : starts[k]], data[starts[k] : ends[k]]):
                return
            ends[j] = ends[k]
            starts[k : k + 1] = ends[k]
            k = j


def _cuts(words: Words, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins a piece, begins a chunk) for each word: every text's first word, and those with the right hash bits before them."""
    if not len(words):
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    owner = np.repeat(np.arange(words.n_texts), words.counts)
    floor = offs[:-1][owner]
    last = np.concatenate([[0], words.ends[:-1]])  # the end of the word before
    rolled = np.zeros(len(words), dtype=np.uint32)
    for k in range(WINDOW):
        at = last - 1 - k
        rolled ^= np.where(at >= floor, _TABLE[k][raw[np.maximum(at, 0)]], 0).astype(np.uint32)
    cut = (rolled & np.uint32((1 << KEEP_BITS) - 1)) != 0
    far = cut & (((rolled >> np.uint32(KEEP_BITS)) & np.uint32((1 << CHUNK_BITS) - 1)) == 0)
    begin = words.of[:-1][words.counts > 0]
    cut[begin] = far[begin] = True
    return cut, far


_coders: dict[str, Coder] = {}


def coder(name: str) -> Coder:
    if name not in _coders:
        _coders[name] = Coder(name)
    return _coders[name]


def _apply(df: DataFrame, text_col: str, tokenizer: str, make, returns: T.StructType) -> DataFrame:
    def run(texts: pa.Array) -> pa.Array:
        made = [make(coder(tokenizer).ids(texts.slice(i, j - i))) for i, j in slices(texts)]
        columns = [pa.concat_arrays([m[k] for m in made]) for k in range(len(returns.fields))] if made else make([])
        return pa.StructArray.from_arrays(columns, returns.fieldNames())

    return with_text_udf(df, text_col, run, returns, lambda: coder(tokenizer).forget())


def encode(df: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """df with ids (array of int) of each whole text, as the tokenizers library encodes it without special tokens added."""

    def make(found):
        ids = [np.frombuffer(i, dtype="<i4") for i in found]
        return [pa.array(ids, pa.list_(pa.int32()))]

    return _apply(df, text_col, tokenizer, make, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _decoded(ids: list[np.ndarray], tokenizer: str) -> Iterator[str]:
    """The library's decode(ids, skip_special_tokens=False) of each array of ids."""
    begin, total = 0, 0
    for k in range(len(ids) + 1):
        if k == len(ids) or (k > begin and total + len(ids[k]) > DECODED):
            yield from coder(tokenizer).tokenizer.decode_batch([i.tolist() for i in ids[begin:k]], skip_special_tokens=False)
            begin, total = k, 0
        total += len(ids[k]) if k < len(ids) else 0


def decode(df: DataFrame, ids_col: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """df with decoded: the library's decode(ids, skip_special_tokens=False); null ids give the empty string."""

    def run(ids: pa.Array) -> pa.Array:
        found = [np.zeros(0, np.int32) if i is None else i.values.to_numpy(zero_copy_only=False) for i in (x if x.is_valid else None for x in ids)]
        return pa.StructArray.from_arrays([pa.array(_decoded(found, tokenizer), pa.string())], ["decoded"])

    return with_text_udf(df, ids_col, run, T.StructType([T.StructField("decoded", T.StringType())]))


def encode_and_decode(df: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """df with ids as encode() gives them, and decoded_sha256 of what decode() makes of these ids; one worker does both."""

    def make(found):
        ids = [np.frombuffer(i, dtype="<i4") for i in found]
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in _decoded(ids, tokenizer)]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array(sha, pa.string())]

    kinds = [("ids", T.ArrayType(T.IntegerType())), ("decoded_sha256", T.StringType())]
    return _apply(df, text_col, tokenizer, make, T.StructType([T.StructField(*k) for k in kinds]))


def digests(df: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """df with n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256 (of the decoded text)."""

    def make(found):
        sha = [[hashlib.sha256(x).hexdigest() for x in some] for some in (found, coder(tokenizer).decoded(found))]
        return [pa.array([len(i) // 4 for i in found], pa.int64()), pa.array(sha[0], pa.string()), pa.array(sha[1], pa.string())]

    kinds = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _apply(df, text_col, tokenizer, make, T.StructType([T.StructField(*k) for k in kinds]))
