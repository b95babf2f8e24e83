"""Byte-level BPE encoding and decoding by a shuffle of distinct words.

Texts are cut into pre-tokens block by block (a block: up to BLOCK characters of a task's texts, or one longer text). A block keeps, for
every text, where each of its distinct words stands, as the sequence of their slots. The distinct words of all blocks are dealt by word
and sorted, so each is encoded once, and its ids go back to the (block, slot) pairs that hold it; there the texts are put together by position.
Decoding joins the ids with the table of the tokens' bytes, which has the vocabulary's fixed size.

A word has one row a block at most, however often it occurs, so a frequent word's share of the shuffle is that of one word of a block. What
a task holds is a block with its words, or the text that is longer.

Null and empty texts have no ids and decode to no bytes; texts of any length are read whole. Special tokens written in a text are ordinary
text. Rows are neither added nor dropped, repeated rows are coded alike, ties can't arise, empty tables give empty results. Other columns
may have any name: they travel in a struct, and come back; one named like a new column is replaced. The text itself doesn't come back.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociflow.cluster import ship
from lociflow.llm.common import bucketed, steady, trim

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a block; words, and pre-tokens of texts, that share a row of it; rows encoded together.
BLOCK, WORDS, TOKENS, TOGETHER = 1 << 25, 10_000, 1 << 18, 1 << 17
_OTHER = "﷐"  # no letter, no number, no space in any version


@lru_cache(2)
def ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """The rank of each token's bytes; vocabulary is a path, or a name of the public files."""
    if not os.path.isabs(vocabulary):
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(2)
def _word_encoder(vocabulary: str):
    """The library's encoder with a pattern that takes any text as one pre-token."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks(vocabulary), special_tokens={})


@lru_cache(2)
def token_bytes(vocabulary: str = VOCABULARY) -> list[bytes | None]:
    """The table of the tokens' bytes by id."""
    table = ranks(vocabulary)
    out: list[bytes | None] = [None] * (max(table.values()) + 1)
    for token, rank in table.items():
        out[rank] = token
    return out


@lru_cache(1)
def _classed_otherwise() -> dict[int, str]:
    """Code points that the tokenizer's library and the regex module class otherwise (their Unicode versions differ), with a stand-in of the library's class."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    one = {bytes([i]): i for i in range(256)}
    theirs, mine = [], []
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        theirs.append(set(bytes(tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=one, special_tokens={}).encode_ordinary(every)).decode()))
        mine.append(set(regex.findall(kind, every)))
    letters, numbers, spaces = theirs
    stand = lambda c: "a" if c in letters else "0" if c in numbers else " " if c in spaces else _OTHER
    return {ord(c): stand(c) for a, b in zip(theirs, mine, strict=True) for c in a ^ b}


@lru_cache(1)
def splitter() -> Callable[[str], list[str]]:
    """The pre-tokens of a text, in order: all matches of the public pattern, which leave no character out."""
    import public_tokenizers
    import regex

    pattern, otherwise = regex.compile(public_tokenizers.PATTERN), _classed_otherwise()
    rare = re.compile(f"[{chr(min(otherwise))}-\U0010ffff]") if otherwise else re.compile(r"(?!)")

    def split(text: str) -> list[str]:
        if text.isascii() or not rare.search(text):
            return pattern.findall(text)
        return [text[m.start() : m.end()] for m in pattern.finditer(text.translate(otherwise))]

    return split


class _Slots(dict):
    """Words numbered as they are met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _pack(*numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of all, compressed."""
    import zstandard

    planes = np.concatenate([x.astype("<u4") for x in numbers]).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _cut(schema: pa.Schema):
    """(row, text) to (block, rows, slots), some texts each, and (block, first, words) for the words of each block.

    slots: how many texts, the number of pre-tokens of each, and all their slots, packed.
    """

    def flush(block: int, rows: list[pa.Array], slots: _Slots, met: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        # frequent words get small numbers
        order = np.argsort(-sum((np.bincount(m, minlength=len(slots)) for m in met), np.zeros(len(slots), np.int64)), kind="stable")
        number = np.empty(len(slots), np.int64)
        number[order] = np.arange(len(slots))
        some, sizes = pa.concat_arrays(rows), np.array([len(m) for m in met])
        # cut where so many tokens are full; a row more each 1000 texts
        group = np.maximum(np.cumsum(sizes) // TOKENS, np.arange(len(sizes)) // 1000)
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
        for a, b in zip(begin, [*begin[1:], len(sizes)], strict=True):
            held = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), some.slice(a, b - a))
            packed = pa.array([_pack(np.array([b - a]), sizes[a:b], number[np.concatenate(met[a:b])])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([block]), held.cast(schema.field("rows").type), packed, pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.string()))], schema=schema)
        words = pa.array(slots.keys(), pa.string()).take(pa.array(order)) if len(slots) else pa.array([], pa.string())
        for at in range(0, len(words), WORDS):
            chunk = pa.array([words.slice(at, WORDS)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, schema.field("rows").type), pa.nulls(1, pa.binary()), pa.array([at], pa.int32()), chunk], schema=schema)

    def run(batches):
        split, block = splitter(), TaskContext.get().partitionId() << 32
        rows, slots, met, held = [], _Slots(), [], 0
        for batch in batches:
            begin = 0
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                if held and held + len(text) > BLOCK:
                    rows.append(batch.column("row").slice(begin, i - begin))
                    yield from flush(block, rows, slots, met)
                    rows, slots, met, held, begin, block = [], _Slots(), [], 0, i, block + 1
                    trim()
                words = split(text)
                met.append(np.fromiter(map(slots.__getitem__, words), np.int32, len(words)))
                held += len(text)
            rows.append(batch.column("row").slice(begin))
        if met:
            yield from flush(block, rows, slots, met)

    return run


def _encoded(vocabulary: str):
    """(block, slot, word) sorted by word to (block, of), of: the slots, the number of ids of each, and the ids, packed for each block."""

    def encode(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        encoder = _word_encoder(vocabulary)
        rows = pa.Table.from_batches(batches)
        words = rows.column("word").combine_chunks()
        new = np.ones(len(words), bool)
        new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
        of = np.cumsum(new) - 1
        ids = [encoder.encode_ordinary(w) for w in words.filter(pa.array(new)).to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        ends, flat = np.cumsum(sizes), np.fromiter((x for i in ids for x in i), np.int64, int(sizes.sum()))
        block, slot = rows.column("block").to_numpy(), rows.column("slot").to_numpy()
        order = np.argsort(block, kind="stable")
        borders = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
        packed = []
        for a, b in zip(borders.tolist(), [*borders[1:].tolist(), len(order)], strict=True):
            here = of[order[a:b]]
            n = sizes[here]
            take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - (ends - sizes)[here], n)
            packed.append(_pack(np.array([b - a]), slot[order[a:b]], n, flat[take]))
        return pa.RecordBatch.from_arrays([pa.array(block[order[borders]]), pa.array(packed, pa.binary())], ["block", "of"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= TOGETHER:
                yield encode(held)
                held, n = [], 0
                trim()
        if n:
            yield encode(held)

    return run


def _joined(make: Callable[[list[bytes]], list[pa.Array]], schema: pa.Schema):
    """A block's texts and the ids of its words to its rows; make: from ids (little-endian, 32 bits) to the new columns."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        ids: list[bytes] = [b""] * sum(int(_unpack(x.as_py())[0]) for x in words.column("of"))
        for x in words.column("of"):
            numbers = _unpack(x.as_py())
            n = int(numbers[0])
            ends, data = (4 * np.cumsum(numbers[n + 1 : 2 * n + 1], dtype=np.int64)).tolist(), numbers[2 * n + 1 :].tobytes()
            for slot, a, b in zip(numbers[1 : n + 1].tolist(), [0, *ends[:-1]], ends, strict=True):
                ids[slot] = data[a:b]
        out = []
        for rows, slots in zip(texts.column("rows"), texts.column("slots"), strict=True):
            numbers = _unpack(slots.as_py())
            n = int(numbers[0])
            ends = (n + 1 + np.cumsum(numbers[1 : n + 1], dtype=np.int64)).tolist()
            for i in range(0, n, 256):
                made = make([b"".join(map(ids.__getitem__, numbers[a:b].tolist())) for a, b in zip([n + 1, *ends[:-1]][i : i + 256], ends[i : i + 256], strict=True)])
                out.append(pa.RecordBatch.from_arrays([rows.values.slice(i, 256).cast(schema.field("row").type), *made], schema=schema))
        trim()
        return pa.Table.from_batches(out, schema)

    return run


def _apply(df: DataFrame, text_col: str, vocabulary: str, make: Callable[[list[bytes]], list[pa.Array]], returns: list[tuple[str, T.DataType]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    taken = {text_col, *(name for name, _ in returns)}
    keep = [c for c in df.columns if c not in taken]
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("one")).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    row = T.StructField("row", T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema["row"].dataType]))
    cut = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(row.dataType)), T.StructField("slots", T.BinaryType()), T.StructField("first", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])
    blocks = bucketed(rows.mapInArrow(steady(_cut(to_arrow_schema(cut))), cut), "block", "blocks")
    words = blocks.where("words IS NOT NULL").select("block", "first", F.posexplode("words").alias("at", "word")).select("block", (F.col("first") + F.col("at")).alias("slot"), "word")
    words = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encoded(vocabulary), "block long, of binary")
    texts = blocks.where("slots IS NOT NULL").select("block", "rows", "slots")
    out = T.StructType([row, *[T.StructField(*r) for r in returns]])
    made = texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_joined(make, to_arrow_schema(out)), out)
    return made.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], *[name for name, _ in returns])


def _decoded(ids: bytes, vocabulary: str) -> bytes:
    return b"".join(map(token_bytes(vocabulary).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(df: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without the text, with ids (array of int) of each whole text, each pre-token coded by the ranks."""

    def make(found: list[bytes]) -> list[pa.Array]:
        return [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in found], pa.list_(pa.int32()))]

    return _apply(df, text_col, vocabulary, make, [("ids", T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with decoded (binary): the bytes of each row's ids; null ids give no bytes, and ids that the table lacks are an error."""
    ship(df.sparkSession)

    @F.arrow_udf(T.BinaryType())
    def run(ids: pa.Array) -> pa.Array:
        return pa.array([_decoded(np.asarray(i.as_py() or [], "<u4").tobytes(), vocabulary) for i in ids], pa.binary())

    return df.withColumn("decoded", run(F.col(f"`{ids_col}`")))


def digests(df: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without the text, with n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256 (of the bytes they decode to)."""

    def make(found: list[bytes]) -> list[pa.Array]:
        decoded = [hashlib.sha256(_decoded(i, vocabulary)).hexdigest() for i in found]
        return [pa.array([len(i) // 4 for i in found], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in found], pa.string()), pa.array(decoded, pa.string())]

    return _apply(df, text_col, vocabulary, make, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())])
