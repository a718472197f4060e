"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from marlstone.errors import Invalid

_MADE: dict[str, SparkSession] = {}


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and the driver runs all tasks, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise Invalid("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "marlstone-tables")


def located(spark: SparkSession, path: str):
    """A path and the file system that it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def reserved(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the program ends."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table: computed once, whatever reads it, and read again where an executor is lost. It is deleted when the program ends."""
    path = reserved(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _drop() -> None:
    for path, spark in _MADE.items():
        with contextlib.suppress(Exception):  # the session may have ended
            at, system = located(spark, path)
            system.delete(at, True)
