"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1. An n-gram is three characters around a letter; its vector binds (multiplies) the characters' vectors, that
at place k permuted k times (a cyclic shift); a text's vector bundles (sums) its n-grams' vectors; a language's
prototype bundles its texts. A text's language is the prototype with the largest cosine.

Texts without a letter and null texts are `und` with score 0; texts of any length are read whole. Empty tables give empty results;
without learned texts all are `und`. Ties go to the first language in code-point order. Rows are neither added nor dropped,
repeated rows are judged alike; input columns named like a new column are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociflow.cluster import ship
from lociflow.llm.common import per_class_sample, steady, with_text_udf
from lociflow.llm.text import slices

DIMENSIONS, GRAM = 1024, 3
#: Texts of each language that a profile is learned from, at most.
SAMPLE_PER_LANGUAGE = 2000
UNKNOWN = "und"
_COLUMNS = 4096  # n-grams whose vectors are held at once


@lru_cache(1)
def _letters() -> np.ndarray:
    """Each code point as a lower-cased letter, or 0 where it is none."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(65536)
def _letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([code, 17]).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)


def _gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bind each row of letters: the product of the letters' vectors, each shifted by its place."""
    out = np.ones((len(grams), DIMENSIONS), dtype=np.int8)
    for k in range(grams.shape[1]):
        letters, at = np.unique(grams[:, k], return_inverse=True)
        out *= np.stack([np.roll(_letter_vector(int(c)), k) for c in letters])[at]
    return out.astype(np.float32)


def _ranks(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(values, return_inverse=True) of numbers below `top`, by a table where that is small."""
    if top > 1 << 22:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(top, dtype=bool)
    seen[values] = True
    found = np.flatnonzero(seen)
    rank = np.zeros(top, dtype=np.int32)
    rank[found] = np.arange(len(found), dtype=np.int32)
    return found, rank[values]


def bundles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, has a letter) of the texts. Runs of other characters count as one gap letter."""
    strings = [t or "" for t in texts.to_pylist()]
    raw = np.frombuffer("\0".join(["", *strings, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = _letters()[raw]
    owner = np.repeat(np.arange(-1, len(strings), dtype=np.int32), [1, *(len(s) + 1 for s in strings)])
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    has = np.zeros(len(strings), dtype=bool)
    has[np.unique(owner[code != 0])] = True
    out = np.zeros((len(strings), DIMENSIONS), dtype=np.float32)
    if len(code) < GRAM:
        return out, has
    alphabet, small = _ranks(code, 0x110000)
    base = len(alphabet)
    key, same = np.zeros(len(code) - GRAM + 1, dtype=np.int32 if base**GRAM < 1 << 30 else np.int64), owner[GRAM - 1 :]
    for k in range(GRAM):
        key = key * base + small[k : len(code) - GRAM + 1 + k]
    # a gap of another text may begin an n-gram: it is the gap letter whosever it is
    inside = (small[GRAM - 2 : -1] != 0) | (alphabet[0] != 0)
    inside &= owner[GRAM - 2 : -1] == same
    key, same = key[inside], same[inside]
    if not len(key):
        return out, has
    grams, at = _ranks(key, base**GRAM)
    letters = np.stack([alphabet[grams // base ** (GRAM - 1 - k) % base] for k in range(GRAM)], axis=1)
    for begin in range(0, len(grams), _COLUMNS):
        here = (at >= begin) & (at < begin + _COLUMNS) if len(grams) > _COLUMNS else slice(None)
        width = min(_COLUMNS, len(grams) - begin)
        rows, local = _ranks(same[here], len(strings))
        counts = np.bincount(local.astype(np.int64) * width + at[here] - begin, minlength=len(rows) * width).reshape(len(rows), width)
        out[rows] += counts.astype(np.float32) @ _gram_vectors(letters[begin : begin + width])
    return out, has


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) of the rows with a language and a text; about `sample` texts of each language at most."""
    ship(df.sparkSession)
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text"), np.array(batch.column("lang").to_pylist(), dtype=object)
            for i, j in slices(texts, 1 << 19):
                vectors = _unit(bundles(texts.slice(i, j - i))[0])
                for lang in set(langs[i:j]):
                    sums[lang] = sums.get(lang, 0) + vectors[langs[i:j] == lang].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [v.tolist() for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    parts = per_class_sample(known, "lang", "i", sample).select("lang", "text").mapInArrow(steady(partial), "lang string, v array<double>")
    rows = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).orderBy("lang").collect()
    prototypes = np.array([[x.x for x in r.v] for r in rows]) if rows else np.zeros((0, DIMENSIONS))
    return [r.lang for r in rows], _unit(prototypes).astype(np.float32)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """df with lang_pred (a learned language or `und`) and score (the cosine, 0 to 1)."""
    names, prototypes = model

    def run(texts: pa.Array) -> pa.Array:
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        for i, j in slices(texts, 1 << 19) if names else ():
            vectors, has = bundles(texts.slice(i, j - i))
            cos = _unit(vectors) @ prototypes.T
            best[i:j] = np.where(has, cos.argmax(axis=1), -1)
            score[i:j] = np.where(has, cos.max(axis=1), 0)
        labels = pa.array([*names, UNKNOWN]).take(pa.array(np.where(best < 0, len(names), best)))
        return pa.StructArray.from_arrays([labels, pa.array(np.clip(score, 0, 1).astype(np.float64))], ["lang_pred", "score"])

    return with_text_udf(df, text_col, run, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
