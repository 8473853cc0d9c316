"""Shared work folder: intermediate tables that must survive the loss of an executor.

A lineage job often needs a small table twice (statistics of a group, keys of suspicious
outputs).  Writing it once gives three things: the plan behind it is cut, the result is fixed
(no re-evaluation of range bounds or partition numbers), and Catalyst sees its true size, so it
broadcasts the table when it is small and shuffles when it is not.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def work_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for local sessions."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="rowtrail-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def _app_folder(spark: SparkSession) -> str:
    return f"{work_root(spark)}/rowtrail/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the tables this application wrote here; frames that read them become unusable."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(_app_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_app_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the work folder and return a frame that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
