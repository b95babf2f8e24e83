"""Small shared pieces of the operators: folds, output columns, labelled samples."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociflow.cluster import shared_dir, ship

#: Letters A-Z and a-z for translate(), where only ASCII is to be lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim() -> None:
    """Give memory that a worker no longer uses back to the machine: workers live on, and others need it."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it likes
        pass


def steady(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow, with memory given back after each batch."""

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(fed(batches))
        trim()

    return run


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(k), F.lit(0))


def spread(id_col: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the id alone, for samples that any rerun repeats."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def with_text_udf(df: DataFrame, text_col: str, fn: Callable[[pa.Array], pa.Array], returns: T.StructType, done: Callable[[], None] | None = None) -> DataFrame:
    """Add the fields that `fn` makes of the text column (Arrow array in, struct array out).

    Every row and column stays; an input column with the name of a new field is replaced. done: called at a task's end, so that
    a worker, which lives on, keeps nothing that only this step needs.
    """
    ship(df.sparkSession)

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield fn(batch)
            trim()
        if done is not None:
            done()
            trim()

    taken = set(returns.fieldNames())
    keep = [F.col(f"`{c}`") for c in df.columns if c not in taken]
    made = df.withColumn("__made", run(F.col(f"`{text_col}`")))
    return made.select(*keep, *[F.col("__made")[f].alias(f) for f in returns.fieldNames()])


def per_class_sample(df: DataFrame, class_col: str, id_col: str, bound: int) -> DataFrame:
    """About `bound` rows of each class at most, chosen by the hash of their ids; classes with fewer rows stay whole.

    One row a class is broadcast: the models fitted on these samples hold a row a class themselves.
    """
    share = df.groupBy(class_col).agg(F.least(F.lit(1.0), F.lit(float(bound)) / F.count(F.lit(1))).alias("__share"))
    return df.join(F.broadcast(share), class_col).where(spread(id_col, 7) < F.col("__share")).drop("__share")


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df written to the shared folder in buckets of the key, so that a join or grouping by it reads them without a shuffle."""
    spark = df.sparkSession
    table = f"lociflow_{name}_{uuid.uuid4().hex}"
    buckets = min(100_000, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.option("path", f"{shared_dir(spark)}/lociflow/{table}").option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)
