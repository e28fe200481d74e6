"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at a time, whatever the Arrow batch holds.
CHUNK_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's default, as rows are whole texts; another value that is set stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``.

    Only where no cluster has named that folder (tests, a laptop) does it fall
    back to one below the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidelog_shared"
    return f"{_scope.get() or base.rstrip('/')}/tidelog-{uuid.uuid4().hex}"


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All folders that :func:`shared_dir` gives inside are deleted at the end: nothing that is still to be read may need them."""
    where = shared_dir(spark)
    token = _scope.set(where)
    try:
        yield
    finally:
        _scope.reset(token)
        dropped(spark, where)


def written(df: DataFrame, where: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, survives lost executors."""
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def dropped(spark: SparkSession, where: str) -> None:
    """Delete a folder made by :func:`written`, by Spark's own file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """``row``: all of ``df``'s columns as one struct, so that none can clash with ``columns``."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, names: list[str], *added: str) -> DataFrame:
    """The struct's columns again, then ``added``; an added column replaces one of the same name."""
    kept = [F.col("row")[n].alias(n) for n in names if n not in added]
    return df.select(*kept, *added)


def document_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Rows that agree in id and text are one document; nulls count as values."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def byte_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column end to end, and offsets (length + 1). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def is_held_out(id_col: str = "doc_id") -> Column:
    """Every fifth document by the CRC-32 of its id as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
