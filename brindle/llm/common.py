"""Helpers shared by the text operators: tables, shared scratch folders, Arrow batches and hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but a space and the five control characters 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master only, one of our own (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="brindle-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialise(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    The files survive lost executors, hold only the columns written and are compressed, which
    ``checkpoint()`` is not. They go with ``release``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    target, fs = _hadoop(spark, path)
    fs.deleteOnExit(target)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a materialised frame that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        target, fs = _hadoop(df.sparkSession, path)
        fs.delete(target, True)


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def tokenizer_path(name: str) -> str:
    """Where the vocabulary files lie by default; operators take the path as a parameter."""
    import public_tokenizers

    return os.path.abspath(public_tokenizers.path(name))


def batches(fn: Callable[..., dict[str, list]], schema: str, spark_schema, *names: str, rows: int = 512, size: int = 2 << 20):
    """A mapInArrow function that calls ``fn`` with one list per named column.

    Batches are cut so that ``fn`` sees at most ``rows`` rows and about ``size`` characters of the first string
    column at once (one row at least), which bounds a worker's memory whatever the batch size of the session.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(spark_schema)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for start, stop in slices(batch, names, rows, size):
                part = batch.slice(start, stop - start)
                out = fn(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow_schema], schema=arrow_schema)

    return run


def slices(batch: pa.RecordBatch, names, rows: int, size: int) -> Iterator[tuple[int, int]]:
    import pyarrow.compute as pc

    n = batch.num_rows
    weight = np.zeros(n, np.int64)
    for name in names:
        col = batch.column(batch.schema.get_field_index(name))
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
            weight += np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
    start, total = 0, 0
    for i in range(n):
        if i > start and (i - start >= rows or total + weight[i] > size):
            yield start, i
            start, total = i, 0
        total += int(weight[i])
    if start < n:
        yield start, n


def map_rows(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, *names: str, rows: int = 512, size: int = 2 << 20) -> DataFrame:
    """Apply ``fn`` (lists in, dict of lists out) to the named columns of ``df`` in Arrow batches."""
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    return df.select(*names).mapInArrow(batches(fn, schema, struct, *names, rows=rows, size=size), struct)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64 on an array of unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def map_append(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, *names: str, rows: int = 512, size: int = 2 << 20) -> DataFrame:
    """``df`` with further columns that ``fn`` makes from the named ones; rows pass through as they are.

    New columns must not be named like those of ``df``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    struct = StructType([*df.schema.fields, *added.fields])
    arrow = to_arrow_schema(added)

    def run(it):
        for batch in it:
            for start, stop in slices(batch, names, rows, size):
                part = batch.slice(start, stop - start)
                out = fn(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(out[f.name], f.type) for f in arrow)], names=[*part.schema.names, *arrow.names])

    return df.mapInArrow(run, struct)
