"""Reads: bounds, isolation, budgets; ends, high watermark and last stable offset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import OffsetOutOfRange
from ..functions.scalars import batch_next_offset
from ..schema import UNSTABLE
from .produce import TP


def checked_range(requested: int, start: int, end: int) -> int:
    """Offsets from the log's start to its end may be asked for; at the end there is nothing yet."""
    if not start <= requested <= end:
        raise OffsetOutOfRange(requested, start, end)
    return requested


def fetch(log: DataFrame, topic: str, partition: int, offset: int, *, end: int | None = None, max_records: int | None = None) -> DataFrame:
    """Data records of one partition from ``offset`` to before ``end``, in offset order.

    0 records gives none, a negative number is an error. Topic and partition
    prune folders, the range reaches the scan.
    """
    if max_records is not None and max_records < 0:
        raise ValueError("max_records must not be negative")
    rows = log.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= offset) & F.col("control").isNull())
    if end is not None:
        rows = rows.where(F.col("offset") < end)
    rows = rows.orderBy("offset")
    return rows if max_records is None else rows.limit(max_records)


def read_batches(batches: DataFrame, offset: int, max_bytes: int, *, end: int | None = None, group: Sequence[str] = TP) -> DataFrame:
    """Whole batches behind ``offset`` while their bytes fit the budget, one at least. Needs base_offset, next_offset, bytes."""
    rows = batches.where(F.col("next_offset") > offset)
    if end is not None:
        rows = rows.where(F.col("base_offset") < end)
    w = Window.partitionBy(*group).orderBy("base_offset")
    rows = rows.withColumn("running", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(w))
    return rows.where((F.col("running") <= max_bytes) | (F.col("nth") == 1)).drop("nth")


def batches(log: DataFrame, size: Column, group: Sequence[str] = TP) -> DataFrame:
    """One row a batch; a control marker's greatest time is -1."""
    return log.groupBy(*group, "base_offset").agg(
        F.max(batch_next_offset("base_offset", "last_offset_delta")).alias("next_offset"), F.count(F.lit(1)).alias("records"),
        F.coalesce(F.max("timestamp_ms"), F.lit(-1)).cast("long").alias("max_timestamp_ms"), F.sum(size).cast("long").alias("bytes"),
    )


def segments(log: DataFrame, size: Column, group: Sequence[str] = TP) -> DataFrame:
    """One row a segment, the last one active."""
    found = log.groupBy(*group, "segment_base").agg(
        F.coalesce(F.max("timestamp_ms"), F.lit(-1)).cast("long").alias("max_timestamp_ms"), F.sum(size).cast("long").alias("bytes"),
    )
    return found.withColumn("active", F.col("segment_base") == F.max("segment_base").over(Window.partitionBy(*group)))


def log_ends(log: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    """start and leo; the end follows the batches, whose last records compaction may have taken."""
    end = F.max(batch_next_offset("base_offset", "last_offset_delta"))
    return log.groupBy(*group).agg(F.min("segment_base").alias("start"), end.alias("leo"), F.max("leader_epoch").alias("leader_epoch"))


def first_offsets(log: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    """Where each transaction first wrote in each partition."""
    return log.where(F.col("transactional_id").isNotNull() & F.col("control").isNull()).groupBy("transactional_id", *group).agg(F.min("offset").alias("first_offset"))


def last_stable(hw: DataFrame, log: DataFrame, states: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    """The least first offset of an unfinished transaction, never over the high watermark."""
    open_ = states.where(F.col("state").isin(*UNSTABLE)).select("transactional_id")
    held = log.where(F.col("control").isNull()).join(open_, "transactional_id").groupBy(*group).agg(F.min("offset").alias("held"))
    return hw.join(held, list(group), "left").withColumn("lso", F.least("hw", F.coalesce("held", "hw"))).drop("held")


def read_committed(log: DataFrame, states: DataFrame, bounds: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    """Data records below the last stable offset, outside transactions or of committed ones (latest state of the id)."""
    rows = log.where(F.col("control").isNull()).join(bounds.select(*group, "lso"), list(group)).where(F.col("offset") < F.col("lso"))
    done = states.where(F.col("state") == "complete_commit").select("transactional_id", F.lit(True).alias("__done"))
    return rows.join(done, "transactional_id", "left").where(F.col("transactional_id").isNull() | F.col("__done")).drop("__done", "lso")


def read_uncommitted(log: DataFrame, hw: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    return log.where(F.col("control").isNull()).join(hw.select(*group, "hw"), list(group)).where(F.col("offset") < F.col("hw")).drop("hw")
