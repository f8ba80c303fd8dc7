"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts lineage and survives the loss of any executor. The folder is
the one named by ``spark.checkpoint.dir``; only where that is unset, as in local
tests, a temporary folder stands in, and only for a local master.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder this module made, through the file system it lies on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Work:
    """Tables of one run of an operator, written once and read back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self._paths = spark, name, {}

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write ``df`` and read it back with the schema it had."""
        path = fresh_path(self.spark, f"{self.name}-{label}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete kept tables that no later step reads."""
        for df in frames:
            path, _ = self._paths.pop(id(df), (None, None))
            if path:
                delete(self.spark, path)
