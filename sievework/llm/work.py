"""Where intermediate tables go, and Arrow helpers shared by the operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Paths that folder() gave out while a scratch() lasts, the innermost last.
_SCRATCH: list[list[str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Where that is unset, a session on
    one machine (tests) gets a temporary folder; on a cluster that would be the
    driver's own disk, so there it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that folder() gave out."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made while it lasts are deleted at its end: what is to stay is written elsewhere before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete(spark, path)


def table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def hashed_joins(spark: SparkSession, most: str = "32m") -> Iterator[None]:
    """While it lasts, joins whose partitions are all below `most` hash one side instead of sorting both.

    A sort takes whole memory pages of its own in every task, however few its
    rows are. Spark decides by the sizes that it has measured; larger joins are
    sorted as ever.
    """
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]
