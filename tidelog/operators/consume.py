"""Groups and consumers: assignment, positions, polls, commits, lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import lag as lag_of
from .produce import TP


def round_robin(partitions: DataFrame, members: DataFrame) -> DataFrame:
    """topic, partition, member_id: partitions in order go to eligible members in turn.

    One turn runs over all topics; a topic without members takes none. Group
    metadata is small: as many rows as a group has partitions and members.
    """
    eligible = members.select("topic", "member_id").distinct()
    ranked = eligible.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy("member_id")) - 1)
    sizes = eligible.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    turn = F.row_number().over(Window.orderBy("topic", "partition")) - 1
    turns = partitions.join(sizes, "topic").withColumn("rank", (turn % F.col("n")).cast("int"))
    return turns.join(ranked, ["topic", "rank"]).select("topic", "partition", "member_id")


def expired(members: DataFrame, now_ms: Column | int) -> DataFrame:
    """Members past their deadline, not those at it."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return members.where(now > F.col("deadline_ms"))


def not_owned(commits: DataFrame, assignment: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    return commits.join(assignment, [*group, "member_id"], "left_anti")


def initial_positions(assignment: DataFrame, committed: DataFrame, bounds: DataFrame, reset: str, group: Sequence[str] = TP) -> DataFrame:
    """Committed offset, else the start (earliest) or end (latest) of what can be read. Bounds: start and hw."""
    start = {"earliest": F.col("start"), "latest": F.col("hw"), "error": F.raise_error(F.lit("no committed offset")).cast("long")}[reset]
    rows = assignment.join(committed.select(*group, F.col("offset").alias("committed")), list(group), "left").join(bounds, list(group))
    return rows.withColumn("position", F.coalesce("committed", start)).select(*assignment.columns, "position")


def poll(log: DataFrame, positions: DataFrame, max_records: int, ends: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    """Up to ``max_records`` of the assigned partitions, greedily in order of topic, partition, offset."""
    if max_records < 0:
        raise ValueError("max_records must not be negative")
    bounds = positions.join(ends.select(*group, F.col("hw").alias("__end")), list(group)).select(*group, "position", "__end")
    rows = log.where(F.col("control").isNull()).join(bounds, list(group)).where((F.col("offset") >= F.col("position")) & (F.col("offset") < F.col("__end")))
    return rows.drop("position", "__end").orderBy(*group, "offset").limit(max_records)


def advanced(positions: DataFrame, polled: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    """Positions behind the last record given out."""
    last = polled.groupBy(*group).agg((F.max("offset") + 1).alias("__next"))
    return positions.join(last, list(group), "left").withColumn("position", F.coalesce("__next", "position")).drop("__next")


def consumer_lag(positions: DataFrame, ends: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    return positions.join(ends.select(*group, "hw"), list(group)).select(*group, lag_of("hw", "position").alias("lag"))


def upserted(offsets: DataFrame, keys: Sequence[str] = ("group_id", *TP), value: str = "offset", order: str = "commit_seq") -> DataFrame:
    """The last write of each key; offsets may go back."""
    return offsets.groupBy(*keys).agg(F.max_by(value, order).alias(value))
