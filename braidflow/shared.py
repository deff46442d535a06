"""Scratch tables in the folder that a cluster's driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

RELEASE_SECONDS = 0.5
_own_dirs: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a temporary folder is made, but only for a local master: on a cluster the
    executors could not see it, so that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dirs.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="braidflow-"))


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no more than a reread.

    drop() removes a table as soon as nothing reads it; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        path = self._path(self.base)
        path.getFileSystem(self._hadoop()).deleteOnExit(path)

    def _hadoop(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(f"{self.base}/{name}")
            path.getFileSystem(self._hadoop()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system that Spark reads has the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that are over, instead of when the driver next collects its garbage."""
    for _ in range(1 if spark.sparkContext.master.startswith("local[") else 3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(RELEASE_SECONDS)  # the files go in the background, on other machines after a message


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
