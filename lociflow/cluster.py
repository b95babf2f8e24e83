"""What every job needs from the cluster: code on the workers, a shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Rows of an Arrow batch, where the session has Spark's own default: rows hold whole texts, which may be long.
_RECORDS, _DEFAULT_RECORDS = "2000", "10000"
_own_dir: list[str] = []


def ship(spark: SparkSession) -> None:
    """Put this package on the Python path of the session's workers, once an application; batches of rows for them stay small."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == _DEFAULT_RECORDS:
        spark.conf.set(batch, _RECORDS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="lociflow-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/lociflow.zip", "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent).as_posix())
    spark.sparkContext.addPyFile(f"{folder}/lociflow.zip")
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one of our own where that is unset and the master is this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} see")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lociflow-shared-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


_stored: dict[str, Folder] = {}


def drop_stored() -> None:
    """Delete every table that is still stored; for a long-lived session, once the results that read them are written."""
    for table in list(_stored.values()):
        table.drop()


class Folder:
    """A new place in the shared folder, for files of any kind."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/lociflow/{name}-{uuid.uuid4().hex}"
        _stored[self.path] = self

    def drop(self) -> None:
        """Delete the files; only once nothing reads them any more."""
        _stored.pop(self.path, None)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Stored(Folder):
    """A DataFrame written to the shared folder: lineage ends here, and a lost executor costs nothing."""

    def __init__(self, df: DataFrame, name: str):
        super().__init__(df.sparkSession, name)
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)
