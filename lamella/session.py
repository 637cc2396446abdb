"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# Runtime settings the models rely on. Join skew is split even where that costs one more
# shuffle, because one key may hold a large share of all rows.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


# Folders to delete when the program ends.
_OWNED: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to a running session."""
    for key, value in TUNING.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="lamella-")
    _OWNED.add(folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def working_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder, kept until the program ends."""
    own = f"{shared_folder(spark).rstrip('/')}/lamella/{spark.sparkContext.applicationId}"
    _OWNED.add(own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


class Workspace:
    """Working copies of one job in the shared folder, removed once the job has succeeded.

    A copy cuts lineage (a job that overwrites what it reads needs that), survives the loss of
    executors, and keeps the columnar layout for the readers that follow. A job that fails leaves
    its copies behind for inspection.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            for path in self.paths:
                remove(self.spark, path)

    def materialize(self, df: DataFrame, label: str = "stage") -> DataFrame:
        """Write ``df`` once and read it back."""
        path = working_path(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system it lies in."""
    _delete(spark.sparkContext._jvm, path, spark.sparkContext._jsc.hadoopConfiguration())


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder another name, in one step where its file system can."""
    location, target = _path(spark, path), _path(spark, to)
    if not location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(location, target):
        raise OSError(f"cannot rename {path} to {to}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder; none where it does not exist."""
    location = _path(spark, path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(location):
        return []
    return sorted(x.getPath().toString() for x in system.listStatus(location) if x.isDirectory())


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _delete(jvm, path: str, configuration) -> None:
    location = jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(configuration).delete(location, True)


def clean_up() -> None:
    """Delete the folders this program has worked in; runs by itself when it ends."""
    jvm = SparkContext._jvm
    while _OWNED:
        path = _OWNED.pop()
        with suppress(Exception):  # a folder left behind must not turn a finished job into a failed one
            _delete(jvm, path, jvm.org.apache.hadoop.conf.Configuration())


atexit.register(clean_up)
