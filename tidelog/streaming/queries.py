"""Structured Streaming twins of the batch operators. Checkpoints and results live in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import keyed_partition
from ..operators import idempotence
from ..sources.shared import shared_dir

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def followed(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a folder's files, or of one file by itself."""
    schema = spark.read.parquet(path).schema
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isFile():
        return reader.option("pathGlobFilter", jvm_path.getName()).parquet(jvm_path.getParent().toString())
    return reader.parquet(path)


def _run(df: DataFrame, where: str, mode: str = "append") -> DataFrame:
    """Takes in what there is now, to the end, and gives the written table."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{where}/out")


def tail(spark: SparkSession, path: str, partitions: int) -> DataFrame:
    """Follows a folder of events and routes those with a key."""
    rows = followed(spark, path).where(F.col("event_id") % 10 != 0)
    routed = rows.select("event_id", keyed_partition(F.col("user_id").cast("string"), partitions).cast("long").alias("part"))
    return _run(routed, shared_dir(spark))


class _Producers(StatefulProcessor):
    """Keeps a producer's state in a partition from one micro-batch to the next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField(n, T.LongType()) for n in idempotence.State._fields]
        self.state = handle.getValueState("producer", T.StructType(fields))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.state.get()
        out, state = idempotence.run_state(pd.concat(list(rows)), idempotence.State(*held) if held else None)
        if state:
            self.state.update(tuple(int(x) for x in state))
        yield out

    def close(self) -> None:
        pass


def deduplicated(batches: DataFrame) -> DataFrame:
    """The idempotence check of a stream of batches; a micro-batch of a producer is taken in send order."""
    return batches.groupBy("topic", "partition", "producer_id").transformWithStateInPandas(_Producers(), idempotence.SCHEMA, "append", "none")


def dedup(spark: SparkSession, batches: DataFrame) -> DataFrame:
    """Streams the batches from a table of their own through :func:`deduplicated`."""
    where = shared_dir(spark)
    batches.write.parquet(f"{where}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        return _run(deduplicated(followed(spark, f"{where}/in")), where)
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """member_id, first, n of each run of a member's events without a pause of ``gap``."""
    return _sessions(events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), gap)


def _sessions(rows: DataFrame, gap: str) -> DataFrame:
    found = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("user_id").alias("member_id"), F.col("session_window.start").alias("first"), "n")


def closed_sessions(spark: SparkSession, path: str, gap: str, late: str) -> DataFrame:
    """Sessions that have timed out, each given once, when the watermark has passed its end."""
    rows = followed(spark, path).select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return _run(_sessions(rows, gap), shared_dir(spark))


def follow_transactionally(source: DataFrame, publish, where: str) -> None:
    """Read-process-write: each micro-batch goes to ``publish(rows, batch_id)``, whose batch id makes a retry harmless."""
    source.writeStream.foreachBatch(publish).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
