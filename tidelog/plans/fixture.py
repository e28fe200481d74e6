"""The event log that queries run over: events as records, with keys, tombstones, transactions, replicas and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import estimated_bytes
from ..operators import produce, replication, visibility
from ..sources.shared import shared_dir

PARTITIONS, BATCH, SEGMENT, ISR_LAG = 3, 16, 256, 100
RETENTION_MS, RETENTION_BYTES, TOMBSTONE_MS = 1_209_600_000, 40_000, 86_400_000
GROUP = ("partition",)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        "event_id", "ts",
        F.when(F.col("event_id") % 10 != 0, F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("value"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("tx-"), F.floor(F.col("event_id") / 50).cast("string"))).alias("transactional_id"),
    )


def _day() -> Column:
    return F.date_trunc("day", "ts")


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return produce.route(keyed(spark, sf_dir), PARTITIONS, ["ts", "event_id"], _day())


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's rows, from the events."""
    rows = produce.assign_offsets(routed(spark, sf_dir), ["ts", "event_id"], _day(), group=GROUP, end="end")
    rows = produce.tag_segments(produce.tag_batches(rows, BATCH, GROUP, "end").drop("end"), SEGMENT)
    return rows.withColumns({"topic": F.lit("events"), "control": F.lit(None).cast("string"), "leader_epoch": F.lit(0).cast("long"), "size": estimated_bytes("key", "value")})


_stored: dict[tuple, str] = {}


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a table, by topic and partition: written once for all queries of an application on the same events."""
    def path(name: str) -> tuple:
        made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    events_path, system = path(f"{sf_dir}/events.parquet")
    status = system.getFileStatus(events_path)
    key = (spark.sparkContext.applicationId, sf_dir, status.getModificationTime(), status.getLen())
    rows = numbered(spark, sf_dir)
    if key in _stored:  # someone may have cleared the shared folder
        done, system = path(f"{_stored[key]}/_SUCCESS")
        if not system.exists(done):
            del _stored[key]
    if key not in _stored:
        where = shared_dir(spark)
        rows.repartitionByRange("partition", "offset").sortWithinPartitions("partition", "offset").write.partitionBy("topic", "partition").parquet(where)
        _stored[key] = where
    return spark.read.schema(rows.schema).parquet(_stored[key]).select(*rows.columns)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    txs = keyed(spark, sf_dir).where(F.col("transactional_id").isNotNull()).select("transactional_id").distinct().withColumn("n", F.substring("transactional_id", 4, 20).cast("int"))
    top = txs.agg(F.max("n").alias("top"))
    state = F.when(F.col("n") * 100 >= F.col("top") * 98, "ongoing").when(F.col("n") % 5 == 3, "complete_abort").otherwise("complete_commit")
    return txs.crossJoin(F.broadcast(top)).select("transactional_id", "n", state.alias("state"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What led to the states: each transaction begins, prepares and completes; the last line but nine is broken."""
    s = states(spark, sf_dir)
    steps = F.when(F.col("state") == "ongoing", F.array(F.lit("ongoing"))).when(
        F.col("state") == "complete_abort", F.array(*map(F.lit, ("ongoing", "prepare_abort", "complete_abort")))
    ).otherwise(F.array(*map(F.lit, ("ongoing", "prepare_commit", "complete_commit"))))
    return s.select("transactional_id", "n", F.posexplode(steps).alias("i", "state")).select(
        "transactional_id", "state", (F.col("n") * 3 + F.col("i")).cast("long").alias("seq"), (F.col("n") != 77).alias("ok"))


def replicas(rows: DataFrame) -> DataFrame:
    """Broker 1 leads; 2 and 3 are 7 and 500 offsets behind."""
    ends = rows.groupBy("partition").agg((F.max("offset") + 1).alias("end"))
    brokers = F.explode(F.array(*[F.struct(F.lit(b).alias("broker_id"), F.lit(d).alias("behind")) for b, d in ((1, 0), (2, 7), (3, 500))])).alias("b")
    found = ends.select("partition", "end", brokers).select(
        "partition", F.col("b.broker_id").alias("broker_id"), (F.col("end") - F.col("b.behind")).alias("leo"),
        (F.col("b.broker_id") == 1).alias("is_leader"), F.lit(0).cast("long").alias("last_fetch_ms"), F.lit(0).cast("long").alias("hw"),
        F.lit(0).cast("long").alias("leader_epoch"))
    return replication.refresh_isr(found, 0, ISR_LAG, 10_000, GROUP)


def watermarks(rows: DataFrame) -> DataFrame:
    return replication.high_watermark(replicas(rows), group=GROUP)


def latest_time(spark: SparkSession, sf_dir: str) -> int:
    return keyed(spark, sf_dir).agg(F.max("timestamp_ms")).first()[0]


def segments(rows: DataFrame) -> DataFrame:
    return visibility.segments(rows, F.col("size"), GROUP)


def sent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producers' batches, error-free: one an event, sequences by producer and epoch."""
    e = events(spark, sf_dir).select(
        F.lit("events").alias("topic"), (F.col("user_id") % PARTITIONS).cast("int").alias("partition"), F.col("user_id").alias("producer_id"), "event_id",
        F.floor(F.col("event_id") / 5000).cast("int").alias("producer_epoch"), (F.col("event_id") % 3 + 1).cast("int").alias("records"))
    before = Window.partitionBy("producer_id", "producer_epoch").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("base_sequence", F.coalesce(F.sum("records").over(before), F.lit(0)).cast("int")).withColumn("send_seq", F.col("event_id") * 2)


def with_retries(batches: DataFrame) -> DataFrame:
    again = batches.where(F.col("event_id") % 7 == 0).withColumn("send_seq", F.col("send_seq") + 1)
    return batches.unionByName(again)
