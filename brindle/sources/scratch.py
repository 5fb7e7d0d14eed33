"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a query are deleted when it ends, not when the driver's JVM collects what refers to them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="brindle-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: computed once, and safe from lost executors. The shuffle files behind it
    go at once; its own files go with ``release``, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    keep_until_end(spark, path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files behind written frames that nothing reads any more."""
    for df in frames:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def keep_until_end(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def signature(spark: SparkSession, path: str) -> str:
    """A hash of the names, lengths and times of the files at or directly below ``path``; it changes when they do."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    facts = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found)
    return hashlib.md5(repr((path, facts)).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
