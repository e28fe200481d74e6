"""From records to log rows: routing, offsets, batches and segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import errors
from ..functions.scalars import keyed_partition

TP = ("topic", "partition")


def dense_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str], chunk: Column, name: str, total: str | None = None) -> DataFrame:
    """0, 1, 2 ... within ``group`` by ``order``, without a task that sees a whole group; and the group's rows, if ``total`` names a column.

    ``chunk`` must not fall as ``order`` rises (a day of the time ordered by).
    Rows are counted per chunk, the counts of earlier chunks added up (one row
    a chunk), and rows numbered within their chunk only; so a group that holds
    most rows is still dealt out.
    """
    rows = df.withColumn("__chunk", chunk)
    counts = rows.groupBy(*group, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("__n").over(Window.partitionBy(*group)).alias(total)] if total else []
    bases = counts.select(*group, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), *whole)
    own = Window.partitionBy(*group, "__chunk").orderBy(*order)
    numbered = rows.withColumn("__row", F.row_number().over(own) - 1)
    return numbered.join(bases, [*group, "__chunk"]).withColumn(name, F.col("__base") + F.col("__row")).drop("__chunk", "__base", "__row", "__n")


def route(df: DataFrame, partitions: int, order: Sequence[str], chunk: Column, key: str = "key", explicit: str | None = None) -> DataFrame:
    """Adds ``partition``: an explicit one, else by key hash, else (no key) the next in turn by send order."""
    sticky = df.where(F.col(key).isNull())
    keyed = df.where(F.col(key).isNotNull()).withColumn("partition", keyed_partition(key, partitions))
    turns = dense_numbers(sticky.withColumn("__all", F.lit(0)), ["__all"], order, chunk, "__turn")
    sticky = turns.withColumn("partition", (F.col("__turn") % partitions).cast("int")).drop("__turn", "__all")
    routed = keyed.unionByName(sticky)
    if explicit:
        routed = routed.withColumn("partition", F.coalesce(F.col(explicit).cast("int"), "partition"))
    return routed


def assign_offsets(df: DataFrame, order: Sequence[str], chunk: Column, ends: DataFrame | None = None, group: Sequence[str] = TP, end: str | None = None) -> DataFrame:
    """Adds ``offset``: dense within a partition, from the partition's end (``ends``: group and leo) or 0 on; and the end after it, if ``end`` names a column."""
    numbered = dense_numbers(df, list(group), order, chunk, "offset", end)
    if ends is None:
        return numbered
    leo = F.coalesce(F.col("leo"), F.lit(0))
    moved = {"offset": F.col("offset") + leo} | ({end: F.col(end) + leo} if end else {})
    return numbered.join(ends.select(*group, "leo"), list(group), "left").withColumns(moved).drop("leo")


def tag_batches(log: DataFrame, records: int, group: Sequence[str] = TP, end: str | None = None) -> DataFrame:
    """Batches of a fixed number of offsets: adds base_offset and last_offset_delta.

    Only a partition's last batch is short: where a column gives the partition's
    end no row needs to see another.
    """
    base = F.col("offset") - F.col("offset") % records
    last = F.least(base + records, F.col(end)) - 1 if end else F.max("offset").over(Window.partitionBy(*group, "base_offset"))
    return log.withColumn("base_offset", base).withColumn("last_offset_delta", (last - F.col("base_offset")).cast("int"))


def tag_segments(log: DataFrame, offsets: int) -> DataFrame:
    return log.withColumn("segment_base", F.col("offset") - F.col("offset") % offsets)


def _folded(df: DataFrame, group: Sequence[str], order: str, size: str, limit: int, name: str, closes_after: bool) -> DataFrame:
    """A running sum that begins anew: after the row that fills it, or before one that would overfill it.

    Each number depends on all rows before, which no built-in function tells.
    Rows are dealt out by group and sorted (spilling if need be); a task then
    carries one sum along, whatever the group's length.
    """
    names = [*group, order, size]
    rows = df.select(*group, F.col(order).cast("long").alias(order), F.col(size).cast("long").alias(size)).repartition(*group).sortWithinPartitions(*group, order)
    kinds = dict(rows.dtypes)
    n = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, number = None, 0, 0
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True))
            out = []
            for key, s in zip(keys, batch.column(n + 1).to_pylist(), strict=True):
                if key != last:
                    last, total, number = key, 0, 0
                if closes_after:
                    out.append(number)
                    total += s
                    if total >= limit:
                        total, number = 0, number + 1
                else:
                    if total and total + s > limit:
                        total, number = 0, number + 1
                    out.append(number)
                    total += s
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(out, pa.int64())], names=[*names[: n + 1], name])

    return rows.mapInArrow(run, ", ".join([*[f"{x} {kinds[x]}" for x in names[: n + 1]], f"{name} long"]))


def close_batches(df: DataFrame, size: str, batch_bytes: int, order: str = "offset", group: Sequence[str] = TP) -> DataFrame:
    """group, order, batch: a batch closes with the record that brings it to ``batch_bytes``."""
    return _folded(df, group, order, size, batch_bytes, "batch", True)


def roll_segments(df: DataFrame, size: str, segment_bytes: int, order: str = "base_offset", group: Sequence[str] = TP) -> DataFrame:
    """group, order, segment: a segment rolls before what would bring it over ``segment_bytes``; a larger batch stands alone."""
    return _folded(df, group, order, size, segment_bytes, "segment", False)


def sample_index(df: DataFrame, size: str, interval_bytes: int, order: str = "base_offset", group: Sequence[str] = TP) -> DataFrame:
    """The first row of each ``interval_bytes``, with its position: group, order, position."""
    folded = _folded(df, group, order, size, interval_bytes, "run", True).join(df.select(*group, order, size), [*group, order])
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = folded.withColumn("position", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))
    first = F.row_number().over(Window.partitionBy(*group, "run").orderBy(order))
    return rows.withColumn("__first", first).where(F.col("__first") == 1).select(*group, order, "position")


def index_floor(targets: DataFrame, index: DataFrame, target: str = "target", order: str = "base_offset", group: Sequence[str] = TP) -> DataFrame:
    """As-of look-up: for each target the position of the greatest indexed offset at or below it.

    Both sides are sorted together once; no pair of target and entry is made.
    """
    both = index.select(*group, F.col(order).alias("__at"), F.lit(0).alias("__kind"), "position").unionByName(
        targets.select(*group, F.col(target).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("position")))
    last = F.last("position", ignorenulls=True).over(Window.partitionBy(*group).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("floor", F.coalesce(last, F.lit(0))).where("__kind = 1").select(*group, F.col("__at").alias(target), F.col("floor").alias("position"))


def due_partitions(pending: DataFrame, now_ms: int, linger_ms: int, group: Sequence[str] = TP) -> DataFrame:
    """Partitions whose first waiting record (by send_seq) was added ``linger_ms`` ago or longer."""
    first = pending.groupBy(*group).agg(F.min_by("added_ms", "send_seq").alias("first_ms"))
    return first.where(F.lit(now_ms) - F.col("first_ms") >= linger_ms).select(*group).orderBy(*group)


def checked_buffer(pending: DataFrame, buffer_bytes: int, size: str = "bytes") -> int:
    """Bytes of all waiting records; more than ``buffer_bytes`` are an error."""
    total = pending.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n
    if total > buffer_bytes:
        raise errors.ProducerBufferFull(f"{total} bytes wait where {buffer_bytes} may")
    return total
