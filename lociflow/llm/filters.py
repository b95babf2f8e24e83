"""Filters of documents and the audit of how they act together.

Whole texts go byte by byte through a finite-state transducer given as a table: the class of the byte before (the state) and the
byte's own class give an action, of which each bit is an output: a word begins, a word ends, a capital, the first byte of a code point, a
symbol. The spans of words are put into an open hash table, where a place's holder is compared with a newcomer byte by byte, so
distinct words are counted exactly. Copies are found by digests of whole texts: the least id of each digest is the one that isn't a copy.

The audit needs only how many documents of a part fail which set of filters, at most 32 counts a part and label; what each of the
120 orders keeps and removes at each step follows from these. So a hot text or part is added up before anything is shuffled.

Null texts count as empty; empty texts have no words, capitals or symbols. Texts of any length are read whole. A null part counts as the empty
string. Repeated rows all count; of rows with equal text and the least id none is a copy, and rows with a null id neither are copies nor make others so. Labels
that repeat for an id count by their largest values; rows without label are neither good nor toxic. Empty tables give empty results.
Other columns than those named aren't read by the audit, and stay in measure(), where one named like a new column is replaced.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociflow.llm.common import with_text_udf
from lociflow.llm.text import buffers, mix, slices

#: Fewest words; least share of distinct words and largest share of capitals, in percent; characters that count as symbols.
FEWEST, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 3, "#$%&*|"
FILTERS = "ABCDE"

# classes of bytes, which are the states too
_SPACE, _OTHER, _CAPITAL, _SYMBOL, _LATER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[ord("A") : ord("Z") + 1] = _CAPITAL
_CLASS[[ord(c) for c in SYMBOLS]] = _SYMBOL
_CLASS[0x80:0xC0] = _LATER  # a code point's further bytes
# actions
_BEGIN, _END, _UPPER, _POINT, _SIGN = 1, 2, 4, 8, 16
_ACTION = np.zeros((5, 5), np.uint8)
_ACTION[_SPACE, 1:] |= _BEGIN
_ACTION[1:, _SPACE] |= _END
_ACTION[:, _CAPITAL] |= _UPPER
_ACTION[:, _SYMBOL] |= _SIGN
_ACTION[:, :_LATER] |= _POINT
_ACTION = _ACTION.ravel()

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_ODD = np.random.default_rng(1212).integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different spans each of n owners has; data ends with 8 bytes or more beyond the last span."""
    if not len(starts):
        return np.zeros(n, np.int64)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # any 8 bytes as a number
    length = ends - starts

    def piece(which: np.ndarray, k: int) -> np.ndarray:
        left = np.minimum(length[which] - 8 * k, 8)
        return eight[starts[which] + 8 * k] & _MASK[left]

    every = np.arange(len(starts))
    with np.errstate(over="ignore"):
        h = mix((owner.astype(np.uint64) * _ODD[0] + length.astype(np.uint64)) * _ODD[1] + piece(every, 0) * _ODD[2])
        k, more = 1, np.flatnonzero(length > 8)
        while len(more):
            h[more] = mix(h[more] * _ODD[3] + piece(more, k))
            k += 1
            more = more[length[more] > 8 * k]
    size = 1 << (2 * len(starts)).bit_length()
    table, place, found = np.full(size, -1, np.int64), (h & np.uint64(size - 1)).astype(np.int64), np.zeros(len(starts), bool)
    while len(every):
        at = place[every]
        free = table[at] < 0
        table[at[free]] = every[free]  # the last of several newcomers stays
        holder = table[at]
        found[every] = holder == every
        rest = holder != every
        every, holder = every[rest], holder[rest]
        same = (owner[every] == owner[holder]) & (length[every] == length[holder])
        k, open_ = 0, np.flatnonzero(same)
        while len(open_):
            unlike = piece(every[open_], k) != piece(holder[open_], k)
            same[open_[unlike]] = False
            k += 1
            open_ = open_[~unlike]
            open_ = open_[length[every[open_]] > 8 * k]
        every = every[~same]
        place[every] = (place[every] + 1) & (size - 1)
    return np.bincount(owner[found], minlength=n)


def transduce(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, n_distinct, n_capitals, n_chars and n_symbols of each text."""
    raw, offs = buffers(texts)
    n = len(offs) - 1
    data = np.full(len(raw) + n + 8, 0x20, np.uint8)  # a space ends every text, and some bytes more for the last word's
    owner = np.repeat(np.arange(n), np.diff(offs))
    data[np.arange(len(raw)) + owner] = raw
    borders = offs + np.arange(n + 1)
    kind = _CLASS[data[: borders[-1]]]
    pair = kind.copy()
    pair[1:] += kind[:-1] * np.uint8(5)
    action = _ACTION[pair]
    count = lambda bit: np.diff(np.searchsorted(np.flatnonzero(action & np.uint8(bit)), borders))
    starts, ends = np.flatnonzero(action & np.uint8(_BEGIN)), np.flatnonzero(action & np.uint8(_END))
    of = np.searchsorted(starts, borders)
    words = np.diff(of)
    return {
        "n_words": words,
        "n_distinct": distinct(data, starts, ends, np.repeat(np.arange(n), words), n),
        "n_capitals": count(_UPPER),
        "n_chars": np.diff(borders) - np.diff(np.searchsorted(np.flatnonzero(kind == _LATER), borders)) - 1,
        "n_symbols": count(_SIGN),
    }


_COUNTS = ["n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols"]


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, n_distinct, n_capitals, n_chars, n_symbols (longs) and text_digest (128 bits) of each whole text."""

    def run(texts: pa.Array) -> pa.Array:
        got = [transduce(texts.slice(i, j - i)) for i, j in slices(texts)]
        columns = [pa.array(np.concatenate([g[c] for g in got] or [np.zeros(0)]).astype(np.int64)) for c in _COUNTS]
        digests = pa.array([hashlib.blake2b(t.as_py() or b"", digest_size=16).digest() for t in texts.cast(pa.large_binary())], pa.binary())
        return pa.StructArray.from_arrays([*columns, digests], [*_COUNTS, "text_digest"])

    returns = T.StructType([*[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("text_digest", T.BinaryType())])
    return with_text_udf(df, text_col, run, returns)


def failures() -> Column:
    """Filters A to D that a measured row fails, as bits 0 to 3."""
    rules = [F.col("n_words") < FEWEST, 100 * F.col("n_distinct") < DISTINCT * F.col("n_words"), 100 * F.col("n_capitals") > CAPITALS * F.col("n_chars"), F.col("n_symbols") > 0]
    return sum((F.when(r, 1 << i).otherwise(0) for i, r in enumerate(rules)), F.lit(0)).cast("int")


def patterns(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, failed, good, toxic, n): how many documents of a part and label fail just the filters in `failed` (bit 4: E)."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("text"))
    rows = measure(rows).select("id", "part", failures().alias("failed"), "text_digest")
    if labels is None:
        rows = rows.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    else:
        known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
        rows = rows.join(known, "id", "left").withColumns({"good": F.coalesce(F.col("q") == 1, F.lit(False)), "toxic": F.coalesce(F.col("t") == 1, F.lit(False))})
    kinds = ["text_digest", "part", "failed", "good", "toxic"]
    by_id = rows.groupBy(*kinds, "id").agg(F.count(F.lit(1)).alias("n"))
    alike = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = alike.groupBy("text_digest").agg(F.min("first.id").alias("least"))
    alike = alike.join(least, "text_digest").withColumn("own", F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0))
    split = alike.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("failed"), F.col("own").alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("own")).alias("n")))).alias("x"))
    return split.where("x.n > 0").groupBy("part", F.col("x.failed").alias("failed"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def audit(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row for each part, order and step.

    shapley: what the step's filter removes, added up over all orders, whichever step it has there.
    """
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    places = [(f, sum(b for g, b in bits.items() if g in before)) for f in FILTERS for r in range(len(FILTERS)) for before in permutations(FILTERS, r) if f not in before and list(before) == sorted(before)]
    spark = df.sparkSession
    counts = patterns(df, labels, id_col, text_col, part_col)
    # a filter after each set of earlier ones: 80 constant places a row
    sets = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(bits[f]).alias("bit"), F.lit(before).alias("before")) for f, before in places])
    placed = counts.withColumn("at", F.explode(sets)).select("part", "failed", "good", "toxic", "n", "at.*")
    here, earlier = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0
    total = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    acts = placed.groupBy("part", "f", "before").agg(
        total(~here & ~earlier).alias("kept"),
        total(here & ~earlier).alias("removed"),
        total(here & earlier).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(here & ~earlier & F.col("good")).alias("good_lost"),
        total(here & ~earlier & F.col("toxic")).alias("toxic_lost"),
    )
    orders_with = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), F.bit_count("before") + 1)
    shares = acts.groupBy("part", "f").agg(F.sum(F.col("removed") * orders_with).alias("shapley"))
    steps = [("".join(o), k + 1, o[k], sum(bits[g] for g in o[:k])) for o in permutations(FILTERS) for k in range(len(FILTERS))]
    table = spark.createDataFrame(steps, "filter_order string, step int, f string, before int")
    out = acts.join(shares, ["part", "f"]).join(F.broadcast(table), ["f", "before"])  # 600 constant rows
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
