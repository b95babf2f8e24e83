"""Painting window by window, as a stream that can be stopped and goes on.

What is to be painted, and with which law, is written first, as a manifest beside a folder of window descriptors. A stream reads the descriptors, a few a
batch; each batch paints its windows and replaces its own folder, so a batch that is tried again leaves nothing twice, and what earlier runs finished is
not painted again. Edges are clipped to the batch's windows before they are dealt.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators import intervals as iv
from lociflow.operators import weave


@dataclass
class WindowedPainting:
    """A folder of painted windows; nothing is read before it is asked for."""

    spark: SparkSession
    folder: str
    manifest: dict

    @staticmethod
    def load(spark: SparkSession, folder: str) -> WindowedPainting:
        return WindowedPainting(spark, folder, json.loads(spark.read.text(f"{folder}/manifest", wholetext=True).first().value))

    @property
    def bounds(self) -> list[tuple[int, float, float]]:
        size, length = self.manifest["size"], self.manifest["length"]
        return [(k, k * size, min((k + 1) * size, length)) for k in range(int(np.ceil(length / size)))]

    def tracks(self) -> DataFrame:
        """(window, sample, left, right, p0, p1, ..., status) of all windows painted so far."""
        states = ", ".join(f"p{s} double" for s in range(len(self.manifest["pi"])))
        return self.spark.read.schema(f"sample {self.manifest['kind']}, left double, right double, {states}, status string, batch int, window int").parquet(f"{self.folder}/painted").drop("batch")

    def windows(self):
        """(left, right, tracks) one by one; each reads its own window's files only."""
        for k, a, b in self.bounds:
            yield a, b, self.tracks().where(F.col("window") == k).drop("window")

    def painting(self) -> DataFrame:
        """All windows as one, joined where they meet."""
        states = [f"p{s}" for s in range(len(self.manifest["pi"]))]
        return iv.merge_runs(self.tracks(), ["sample"], [*states, "status"], self.manifest["size"]).select("sample", "left", "right", *states, "status")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def paint_windows(edges: DataFrame, nodes: DataFrame, samples: DataFrame, q: np.ndarray, pi: np.ndarray, length: float, size: float, folder: str, together: int = 1, **how) -> WindowedPainting:
    """Paint 0 to length in windows of the size into the folder, `together` a batch; how: what weave.paint takes besides.

    A folder with a manifest is gone on with, and must be of the same painting.
    """
    spark = edges.sparkSession
    told = {"length": float(length), "size": float(size), "q": np.asarray(q, float).tolist(), "pi": np.asarray(pi, float).tolist(), "kind": dict(samples.dtypes)["sample"], "how": {k: repr(v) for k, v in sorted(how.items()) if not isinstance(v, DataFrame)}}
    if _exists(spark, f"{folder}/manifest/_SUCCESS"):
        if WindowedPainting.load(spark, folder).manifest != told:
            raise ValueError(f"{folder} holds another painting")
    else:
        spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    if not _exists(spark, f"{folder}/windows/_SUCCESS"):
        n = int(np.ceil(length / size))
        spark.range(n).coalesce(1).select(F.col("id").cast("int").alias("window")).write.mode("overwrite").option("maxRecordsPerFile", together).parquet(f"{folder}/windows")

    def paint(batch: DataFrame, number: int) -> None:
        found = None
        for k in sorted(r.window for r in batch.collect()):  # `together` rows
            a, b = k * float(size), min((k + 1) * float(size), float(length))
            inside = edges.where((F.col("left") < b) & (F.col("right") > a)).withColumns({"left": F.greatest("left", F.lit(a)) - a, "right": F.least("right", F.lit(b)) - a})
            masks = how.get("masks")
            if masks is not None:
                masks = masks.where((F.col("left") < b) & (F.col("right") > a)).withColumns({"left": F.greatest("left", F.lit(a)) - a, "right": F.least("right", F.lit(b)) - a})
            got = weave.paint(inside, nodes, samples, q, pi, b - a, None, **{**how, "masks": masks})
            got = got.withColumns({"left": F.col("left") + a, "right": F.col("right") + a, "window": F.lit(k)})
            found = got if found is None else found.unionByName(got)
        if found is not None:
            found.write.mode("overwrite").partitionBy("window").parquet(f"{folder}/painted/batch={number}")

    stream = spark.readStream.schema("window int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/windows")
    query = stream.writeStream.foreachBatch(paint).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return WindowedPainting.load(spark, folder)
