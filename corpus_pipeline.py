"""A tokenized training corpus from raw documents, in five stages; each is a step of the operators in lociflow.llm.

Every stage works on all that its predecessor kept, and all but the last return the columns of documents, so an input
column named like an operator's output stays what it was. Empty tables stay empty; null and empty texts leave with the language
stage, which knows no language for them; texts of any length are read whole. Ids may be null or repeat: the dedup stage
knows a row by its id and text, so of repeated rows one stays, and the row with the least id of a group is the one that does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.cluster import Stored
from lociflow.llm import bpe, langid, mixing, neardup, toxicity

#: Texts are judged with those of about their length: classes of doubling lengths. A text leaves if its cosine is below this
#: share of the least that all but one in TAIL of the texts of its class reach.
TAIL, SHARE = 200, 0.5


def _apart(docs: DataFrame) -> tuple[DataFrame, str, list[Column]]:
    """(docs under numbered names, the text's, the columns under their own names again): no new column can take the place of theirs."""
    names = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, names["text"], [F.col(n).alias(c) for c, n in names.items()]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter, and those that resemble no learned language, given what texts of their length score.

    A short text has few n-grams, and so a low cosine by nature: each class of lengths has a level of its own, from the scores of
    all documents in it. The level is half of what all but the lowest of them reach, so documents in a learned language stay.
    """
    renamed, text, own = _apart(docs)
    named = langid.predict(renamed.withColumn("__class", F.floor(F.log2(F.length(text) + 1)).cast("int")), langid.fit(docs), text)
    named = named.where(F.col("lang_pred") != langid.UNKNOWN)  # looked at twice: that costs less than a second copy of the documents
    levels = Stored(named.groupBy("__class").agg((F.percentile_approx("score", F.lit(1.0 / TAIL), F.lit(10_000)) * SHARE).alias("__level")), "levels").df
    kept = named.join(F.broadcast(levels), "__class").where(F.col("score") >= F.col("__level"))  # a row for each doubling of the length
    return kept.select(*own)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the model of the labelled ones calls toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    renamed, text, own = _apart(docs)
    return toxicity.score(renamed, model, text).where("predicted = 0").select(*own)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one with the smallest id, null ids last, of equal ids and texts one row.

    A row goes by a digest of its id and text, so rows that share an id are told apart and documents needn't be numbered and stored again.
    """
    names = docs.columns
    part = lambda c: F.coalesce(F.concat(F.lit("1"), F.col(c).cast("string")), F.lit("0"))
    keyed = docs.withColumn("__key", F.md5(F.concat_ws(" ", part("doc_id"), part("text"))))
    found = neardup.near_duplicates(keyed.select("__key", "text"), id_col="__key").select(F.col("__key").alias("__k"), F.col("component_id").alias("__group")).distinct()
    ids = keyed.groupBy("__key", "doc_id").agg(F.count(F.lit(1)).alias("__n")).join(found, F.col("__key") == F.col("__k"))
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__key", "__n")
    best = Stored(ids.groupBy("__group").agg(F.min(least).alias("b")).select(F.col("b.__key").alias("__kept"), F.col("b.__n").alias("__n")), "kept").df
    kept = lambda some: keyed.join(best.where(some), F.col("__key") == F.col("__kept"), "left_semi")
    if best.where("__n > 1").isEmpty():
        return kept(F.lit(True)).select(*names)
    repeated = kept(F.col("__n") > 1).groupBy("__key").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in names])).alias("__row"))
    return kept(F.col("__n") == 1).select(*names).unionByName(repeated.select("__row.*"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources have their target weights."""
    return mixing.repeated(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document and decode its ids; as many rows as documents, repeats included."""
    coded = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("language ID", known_language),
    ("toxicity", not_toxic),
    ("MinHash near-dedup", deduplicated),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokenized),
]

#: Learned models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on documents; each but the last is written to the shared folder before the next reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        table = Stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            before.drop()
        docs, before = table.df, table
    return STAGES[-1][1](spark, docs, sf_dir)
