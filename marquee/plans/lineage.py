"""Intermediate results that must be computed once and survive lost executors."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    A temporary folder is used only in local mode, where driver and executors share a disk.
    """
    global _local_folder
    context = spark.sparkContext
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):  # a local cluster is a cluster
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="marquee-")
    return _local_folder


def run_folder(spark: SparkSession) -> str:
    """Where everything that this application writes in between goes."""
    return f"{shared_folder(spark)}/marquee-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate results; to be called when all results are read."""
    delete(spark, run_folder(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results that nobody will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def set_checkpoints(spark: SparkSession) -> None:
    """Let Spark's own iterations cut their lineage in the shared folder, as the setting says."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{run_folder(spark)}/checkpoints")


def reclaim(spark: SparkSession) -> None:
    """Delete shuffle files and cached blocks of finished work that nothing refers to any more.

    Spark finds them by garbage collection on the driver, which has no reason to run while only
    the executors' disks fill up. What is still referred to stays.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Unlike a cache it outlives executors, and unlike re-evaluation it gives the same rows to
    every reader, which matters for anything derived from sampled range bounds.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
