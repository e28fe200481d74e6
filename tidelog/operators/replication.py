"""Replica state: in-sync sets, watermarks, acknowledgements, failover. A replica row: group, broker_id, leo, last_fetch_ms, in_sync, is_leader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .produce import TP


def leader_end(group: Sequence[str] = TP) -> Column:
    return F.max(F.when(F.col("is_leader"), F.col("leo"))).over(Window.partitionBy(*group))


def refresh_isr(replicas: DataFrame, now_ms: int, lag_offsets: int, lag_ms: int, group: Sequence[str] = TP) -> DataFrame:
    """in_sync: the leader, and followers within both lags that reach the high watermark (column hw)."""
    near = (F.col("leader_leo") - F.col("leo") <= lag_offsets) & (now_ms - F.col("last_fetch_ms") <= lag_ms) & (F.col("leo") >= F.col("hw"))
    return replicas.withColumn("leader_leo", leader_end(group)).withColumn("in_sync", F.col("is_leader") | near).drop("leader_leo")


def startup_isr(replicas: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    return replicas.withColumn("leader_leo", leader_end(group)).withColumn("in_sync", F.col("leo") == F.col("leader_leo")).drop("leader_leo")


def high_watermark(replicas: DataFrame, previous: Column | int = 0, group: Sequence[str] = TP) -> DataFrame:
    """The least end of the in-sync set, never below the one before."""
    before = F.lit(previous) if isinstance(previous, int) else F.max(previous)
    return replicas.groupBy(*group).agg(F.greatest(before, F.min(F.when(F.col("in_sync"), F.col("leo")))).cast("long").alias("hw"))


def startup_watermark(replicas: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    return replicas.groupBy(*group).agg(F.min("leo").alias("hw"))


def ack_status(waiters: DataFrame, replicas: DataFrame, min_in_sync: int, group: Sequence[str] = TP) -> DataFrame:
    """Of each waiter (group, target, isr: brokers in sync when it began): failed, done or waiting."""
    now = replicas.groupBy(*group).agg(F.count_if("in_sync").alias("in_sync_now"))
    each = waiters.select(*group, "target", F.explode("isr").alias("broker_id")).join(replicas.select(*group, "broker_id", "leo"), [*group, "broker_id"], "left")
    reached = each.groupBy(*group, "target").agg(F.bool_and(F.coalesce(F.col("leo") >= F.col("target"), F.lit(False))).alias("reached"))
    status = F.when(F.col("in_sync_now") < min_in_sync, "failed").when(F.col("reached"), "done").otherwise("waiting")
    return reached.join(now, list(group)).select(*group, "target", status.alias("status"))


def promote(replicas: DataFrame, broker_id: int, group: Sequence[str] = TP) -> DataFrame:
    """After failover to an in-sync broker: it leads alone in sync, cut to the high watermark; the epoch rises. Needs hw and leader_epoch."""
    new = F.col("broker_id") == broker_id
    return replicas.withColumns({
        "leo": F.when(new, F.least("leo", "hw")).otherwise(F.col("leo")), "is_leader": new, "in_sync": new, "leader_epoch": F.col("leader_epoch") + 1,
    })


def rejoin(replicas: DataFrame, broker_id: int, group: Sequence[str] = TP) -> DataFrame:
    """A former leader comes back cut to the high watermark, out of sync until it has caught up."""
    back = F.col("broker_id") == broker_id
    return replicas.withColumns({"leo": F.when(back, F.least("leo", "hw")).otherwise(F.col("leo")), "in_sync": F.col("in_sync") & ~back})


def divergent(log: DataFrame, hw: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    """Records of an old leader that the new one never had to keep."""
    return log.join(hw.select(*group, "hw"), list(group)).where(F.col("offset") >= F.col("hw")).drop("hw")


def pending(batches: DataFrame, followers: DataFrame, group: Sequence[str] = TP) -> DataFrame:
    """Batches that each follower has still to copy."""
    return batches.join(followers.select(*group, "broker_id", "leo"), list(group)).where(F.col("next_offset") > F.col("leo")).drop("leo")
