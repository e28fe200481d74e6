"""Transaction journal: valid prefix, latest states, recovery, and what becomes visible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .produce import TP


def valid_prefix(journal: DataFrame, order: str = "seq", ok: str = "ok") -> DataFrame:
    """Rows before the first broken one. The first broken place is one number, so nothing is sorted."""
    broken = journal.where(~F.coalesce(F.col(ok), F.lit(False))).agg(F.min(order).alias("__broken"))
    return journal.crossJoin(F.broadcast(broken)).where(F.col("__broken").isNull() | (F.col(order) < F.col("__broken"))).drop("__broken")


def latest_states(journal: DataFrame, order: str = "seq") -> DataFrame:
    return journal.groupBy("transactional_id").agg(F.max_by("state", order).alias("state"))


def recovered(states: DataFrame) -> DataFrame:
    """A prepared outcome is completed; what was only ongoing stays so."""
    return states.withColumn("state", F.when(F.col("state") == "prepare_commit", "complete_commit").when(F.col("state") == "prepare_abort", "complete_abort").otherwise(F.col("state")))


def published_offsets(staged: DataFrame, states: DataFrame, keys: Sequence[str] = ("group_id", *TP)) -> DataFrame:
    """Staged offsets of committed transactions; the last stage of each key counts."""
    done = states.where(F.col("state") == "complete_commit").select("transactional_id")
    return staged.join(done, "transactional_id").groupBy(*keys).agg(F.max_by("offset", "seq").alias("offset"))
