"""The registered queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.cluster import Stored
from lociflow.llm import bpe, byte_bpe, codes, filters, langid, licenses, lm, mixing, neardup, tiff, toxicity, urls, vectors
from lociflow.llm.common import fold


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.fit(docs.where(fold("doc_id", 4) != 2), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.withColumn("held_out", fold("doc_id", 4) == 2), model).select("doc_id", "held_out", "score", "predicted", "n_passages")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir, "doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "source", "text")
    sizes = Stored(docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("words")), "sizes").df  # texts are read once
    return mixing.mix(sizes, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    return langid.predict(docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    gathered = Stored(lm.gather(docs.where(fold("doc_id", 7) != 2)), "gathered").df
    return lm.score(docs.withColumn("held_out", fold("doc_id", 7) == 2), gathered, lm.fit(gathered))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(_documents(spark, sf_dir, "doc_id", "text")).drop("text")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "n_strict", "soft_weight")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_documents(spark, sf_dir, "doc_id", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(_documents(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_lm_score": op6_lm_score,
    "op7_bpe": op7_bpe,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_tiff": op9_tiff,
    "op10_url_filter": op10_url_filter,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_filter_audit": op12_filter_audit,
    "op13_vector_codes": op13_vector_codes,
}
