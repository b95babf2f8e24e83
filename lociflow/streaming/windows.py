"""Windowed, resumable painting as a file stream: what a window gets is written once, however often the job restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.cluster import shared_dir


def stream_windows(spark: SparkSession, folder: str, name: str, schema, width: float, out: str, state: str) -> DataFrame:
    """Read `name` of a folder as a stream, put each event in its window of the axis and append it to `out` partitioned by window.

    The checkpoint in `state` lets a stopped run go on; finished files aren't read again. Returns the table written.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    many = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    # a stream reads folders: the table's own, or the one that holds its single file
    source, only = (f"{folder}/{name}.parquet", "*.parquet") if many else (folder, f"{name}.parquet")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", only).parquet(source)
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    placed = stream.withColumn("pos", micros / F.lit(1e6)).withColumn("window", F.floor(F.col("pos") / F.lit(width)).cast("int"))
    query = placed.select("window", "user_id", "pos", "event_type", "value").writeStream.format("parquet").partitionBy("window").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("window int, user_id long, pos double, event_type string, value double").parquet(out)


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh output and checkpoint folder in the shared place."""
    import uuid

    base = f"{shared_dir(spark)}/lociflow/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"
