"""Tables and folders that driver and executors share while an application runs."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def _where(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in local mode, where it may be unset, in a temporary one.

    What is written there is deleted when the application ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local(spark.sparkContext.applicationId)
    path = f"{root}/strandmill/{name}-{uuid.uuid4().hex}"
    where, system = _where(spark, path)
    system.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to a new path and read back, which cuts its lineage, and the path."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    where, system = _where(spark, path)
    system.delete(where, True)
