"""Toxicity by maximum-scoring segments.

A word's score is its log-odds between toxic and clean texts under a Dirichlet prior; words whose z-score does not
reach `Z` score -DRIFT. A linear scan finds every maximal segment of a text's scores, extreme-value statistics of the
clean background say how many segments as good a text of its length has by chance, and a logistic curve fitted on the
labelled sample turns a text's evidence into a probability.

The words' scores are learned from the whole sample; background statistics and the curve from what each of FOLDS parts of it
scores with words learned from the other parts, so no text is judged by scores that have seen it.

Null and empty texts have no segment and so the curve's lowest value. Texts are read whole, in time linear in their words. Empty
tables give empty results; without
both labels in the sample every score is 0. Copies (texts with the same minimal
shingle) are counted once in training; elsewhere repeated rows are scored alike. Equal segments keep text order. Rows are
neither added nor dropped by `score`; input columns named like a new column are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociflow.cluster import Stored, ship
from lociflow.llm.common import per_class_sample, steady, with_text_udf
from lociflow.llm.text import Words, shingles, slices

#: Labelled texts of each class that the model is learned from, at most.
SAMPLE_PER_LABEL = 5000
#: The Dirichlet prior of a word: FLAT, and its share of the sample times PRIOR.
FLAT, PRIOR, Z, DRIFT, THRESHOLD = 0.25, 500.0, 2.5, 0.1, 0.3
#: Segments with fewer expected by chance are significant.
E_VALUE = 0.05
#: Parts of the sample for the curve.
FOLDS = 4
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    rate: float  # lambda of the extreme-value law
    scale: float  # its K
    weights: tuple[float, ...]

    def evidence(self, score: float, n: int) -> float:
        """-ln of the number of segments as good that n background words have by chance."""
        return self.rate * score - math.log(max(self.scale * n, 1e-300))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) in one scan, linear in the number of scores.

    Each candidate keeps where the nearest one that starts lower is. A search goes along these links; those it
    passes start no lower than the newcomer, whose own link leads past them, so none is passed twice.
    """
    found: list[tuple[int, int, float, float, int]] = []  # begin, end, sum before, sum to the end, link
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        begin, left, k = i, before, len(found) - 1
        while k >= 0 and found[k][2] >= left:
            k = found[k][4]
        while k >= 0 and found[k][3] < total:
            begin, _, left, _, lower = found[k]
            del found[k:]
            k = lower
        found.append((begin, i + 1, left, total, k))
    return [(a, b, r - left) for a, b, left, r, _ in found]


def segments(text: str | None, model: Model) -> tuple[int, list[tuple[int, int, float]], int]:
    """(words, maximal segments, distinct words with a positive score) of a text."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return 0, [], 0
    get = model.scores.get
    scores = [get(w, -DRIFT) for w in words]
    if max(scores) <= 0:
        return len(words), [], 0
    return len(words), maximal_segments(scores), len({w for w, s in zip(words, scores, strict=True) if s > 0})


def _features(n: int, scores: list[float], distinct: int, model: Model) -> list[float]:
    gains = [max(0.0, model.evidence(s, n)) for s in scores]
    return [1.0, math.log1p(max(gains, default=0.0)), math.log1p(sum(gains)), math.log1p(sum(scores)), math.log1p(distinct)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(df: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", sample: int = SAMPLE_PER_LABEL) -> Model:
    """The model of df's rows that labels (id, label 0 or 1; the larger where an id repeats) tells of.

    About `sample` ids of each label are chosen before any text is met, so their table is small and the texts stay in place.
    """
    ship(df.sparkSession)
    told = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    ids = df.select(F.col(id_col).alias("i")).join(told, "i")
    chosen = F.broadcast(per_class_sample(ids, "y", "i", sample).distinct())
    known = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("text"))

    def keyed(batches):
        for batch in batches:
            texts, keys = batch.column("text"), []
            for i, j in slices(texts):
                h, owner = shingles(Words(texts.slice(i, j - i)))
                first = np.searchsorted(owner, np.arange(j - i))
                keys.append(np.where(first < len(h), h[np.minimum(first, max(len(h) - 1, 0))] if len(h) else 0, 0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("y"), texts, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))], ["y", "text", "key"])

    rows = known.join(chosen, "i").select("y", "text").mapInArrow(steady(keyed), "y int, text string, key long")
    kept = Stored(rows.groupBy("key", "y").agg(F.min("text").alias("text")).select("y", "text", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-sample")
    rows = kept.df

    def counted(batches):
        counts: dict[tuple[int, int], Counter] = {}
        for batch in batches:
            for y, fold, text in zip(*(batch.column(c).to_pylist() for c in ("y", "fold", "text")), strict=True):
                counts.setdefault((y, fold), Counter()).update(set(_WORD.findall(text.lower())))
        schema = pa.schema([("word", pa.string()), ("fold", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
        for (y, fold), words in counts.items():
            n, none = list(words.values()), [0] * len(words)
            yield pa.RecordBatch.from_pydict({"word": list(words), "fold": [fold] * len(words), "a": n if y else none, "b": none if y else n}, schema=schema)

    tallied = Stored(rows.mapInArrow(steady(counted), "word string, fold int, a long, b long").groupBy("word", "fold").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "toxicity-words")

    def lexicon(without: int) -> Model:
        seen = tallied.df.where(F.col("fold") != without).groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        n_a, n_b = (float(v or 0) for v in seen.agg(F.sum("a"), F.sum("b")).first())
        share = FLAT + PRIOR / max(1.0, n_a + n_b) * (F.col("a") + F.col("b"))
        odds = seen.select("word", (F.col("a") + share).alias("x"), (F.col("b") + share).alias("y"))
        odds = odds.withColumn("s", F.ln(F.col("x") / (n_a + PRIOR - F.col("x"))) - F.ln(F.col("y") / (n_b + PRIOR - F.col("y"))))
        found = odds.where(F.abs(F.col("s")) / F.sqrt(1 / F.col("x") + 1 / F.col("y")) >= Z).select("word", "s", (F.col("y") / (n_b + PRIOR)).alias("p")).orderBy("word").collect()
        rate = _rate(np.array([r.s for r in found] + [-DRIFT]), np.array([r.p for r in found] + [max(1e-9, 1 - sum(r.p for r in found))]))
        return Model({r.word: r.s for r in found}, rate, 1.0, ())

    whole, drafts = lexicon(-1), [lexicon(k) for k in range(FOLDS)]
    tallied.drop()

    def measured(batches):
        for batch in batches:
            folds = batch.column("fold").to_pylist()
            found = [segments(t, drafts[k]) for t, k in zip(batch.column("text").to_pylist(), folds, strict=True)]
            lists = [pa.array([[s for _, _, s in f] for _, f, _ in found], pa.list_(pa.float64())), pa.array([d for _, _, d in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("fold"), pa.array([n for n, _, _ in found], pa.int64()), *lists], ["y", "fold", "n", "s", "d"])

    got = rows.mapInArrow(steady(measured), "y int, fold int, n long, s array<double>, d long").collect()  # as many rows as the sample has
    kept.drop()
    if len({r.y for r in got}) < 2:
        return Model({}, 1.0, 1.0, (-30.0, 0.0, 0.0, 0.0, 0.0))
    clean = [r for r in got if r.y == 0]
    floor = min((s for r in clean for s in r.s), default=1.0)
    scale = (sum(len(r.s) for r in clean) + 0.5) / max(1.0, sum(r.n * math.exp(-drafts[r.fold].rate * floor) for r in clean))
    drafts = [Model(d.scores, d.rate, scale, ()) for d in drafts]
    x = [_features(r.n, r.s, r.d, drafts[r.fold]) for r in got]
    return Model(whole.scores, whole.rate, scale, tuple(_logistic(np.array(x), np.array([float(r.y) for r in got])).tolist()))


def _rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1."""
    shares = shares / shares.sum()
    if not (scores > 0).any() or (scores * shares).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (shares * np.exp(np.minimum(high * scores, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (shares * np.exp(np.minimum(mid * scores, 700))).sum() < 1 else (low, mid)
    return high


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1), predicted (1 from THRESHOLD on) and n_passages (significant segments)."""

    def run(texts: pa.Array) -> pa.Array:
        w, limit = np.array(model.weights), -math.log(E_VALUE)
        values, passages = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int32)
        for i, text in enumerate(texts):
            n, found, distinct = segments(text.as_py(), model)
            values[i] = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(w @ _features(n, [s for _, _, s in found], distinct, model))))))
            passages[i] = sum(model.evidence(s, n) >= limit for _, _, s in found)
        return pa.StructArray.from_arrays([pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32)), pa.array(passages)], ["score", "predicted", "n_passages"])

    return with_text_udf(df, text_col, run, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_passages", T.IntegerType())]))


def passages(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """One row for each significant passage: df's columns with passage struct(begin, end, score, e_value, text); begin and end count characters."""
    kind = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType()), T.StructField("text", T.StringType())]))

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            n, found, _ = segments(text, model)
            low = (text or "").lower()
            source = text if text is not None and len(low) == len(text) else low
            spans = [m.span() for m in _WORD.finditer(low)] if found else []
            rows = [(spans[a][0], spans[b - 1][1], s, math.exp(-min(700.0, model.evidence(s, n)))) for a, b, s in found]
            out.append([{"begin": a, "end": b, "score": s, "e_value": e, "text": source[a:b]} for a, b, s, e in rows if e <= E_VALUE])
        element = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64()), ("text", pa.string())])
        return pa.StructArray.from_arrays([pa.array(out, pa.list_(element))], ["passage"])

    made = with_text_udf(df, text_col, run, T.StructType([T.StructField("passage", kind)]))
    return made.withColumn("passage", F.explode("passage"))
