"""Compaction, retention and truncation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import StorageError
from ..functions.scalars import is_tombstone
from .produce import TP


def compact(log: DataFrame, now: Column | int, delete_retention_ms: int, group: Sequence[str] = TP, protect_active: bool = True) -> DataFrame:
    """Keeps of closed segments the latest record of each key, and all without a key.

    Records of the active segment stay, and count for what is latest. A latest
    tombstone goes when it is older than the retention (more than, not as old).
    The latest offset of a key is a grouped maximum, partial before the
    shuffle, so that a key with a third of all records does not meet in a task.
    """
    latest = log.where(F.col("key").isNotNull()).groupBy(*group, "key").agg(F.max("offset").alias("__latest"))
    now = F.lit(now) if isinstance(now, int) else now
    rows = log.join(latest, [*group, "key"], "left")
    keep = F.col("key").isNull() | (F.col("offset") == F.col("__latest")) & ~(is_tombstone("key", "value") & (now - F.col("timestamp_ms") > delete_retention_ms))
    if protect_active:
        last = log.groupBy(*group).agg(F.max("segment_base").alias("__active"))
        rows = rows.join(last, list(group))
        keep = keep | (F.col("segment_base") == F.col("__active"))
    return rows.where(keep).select(*log.columns)


def retention(segments: DataFrame, now: Column | int, retention_ms: int | None = None, retention_bytes: int | None = None, group: Sequence[str] = TP) -> DataFrame:
    """Closed segments to delete: the oldest while they are out of time, and the oldest while the log is over size.

    Time stops at the first segment that is not over age.
    """
    now = F.lit(now) if isinstance(now, int) else now
    w = Window.partitionBy(*group).orderBy("segment_base")
    gone = F.lit(False)
    if retention_ms is not None:
        old = (F.col("max_timestamp_ms") < now - retention_ms).cast("int")
        gone = gone | (F.min(old).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    if retention_bytes is not None:
        before = F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        gone = gone | (F.sum("bytes").over(Window.partitionBy(*group)) - before > retention_bytes)
    return segments.withColumn("__gone", gone).where(~F.col("active") & F.col("__gone")).drop("__gone")


def log_start(segments: DataFrame, deleted: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    return segments.join(deleted.select(*group, "segment_base"), [*group, "segment_base"], "left_anti").groupBy(*group).agg(F.min("segment_base").alias("log_start"))


def checked_prefix(closed: Sequence[int], requested: Sequence[int]) -> None:
    """Only a run of the oldest closed segments may be deleted."""
    if sorted(requested) != sorted(closed)[: len(set(requested))]:
        raise StorageError("segments to delete must be the oldest closed ones")


def truncate(log: DataFrame, next_offset: Column | int, group: Sequence[str] = TP) -> DataFrame:
    """Batches that end at or before ``next_offset``."""
    end = F.lit(next_offset) if isinstance(next_offset, int) else next_offset
    return log.where(F.col("base_offset") + F.col("last_offset_delta") + 1 <= end)


def checked_boundary(log: DataFrame, next_offset: int) -> None:
    """A log can only be cut between batches."""
    inside = log.where((F.col("base_offset") < next_offset) & (F.col("base_offset") + F.col("last_offset_delta") + 1 > next_offset))
    if inside.limit(1).count():
        raise StorageError(f"{next_offset} is inside of a batch")
