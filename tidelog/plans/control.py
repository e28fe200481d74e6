"""Queries that drive the store, its sessions and its codec over whole tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Isolation, LogConfig, Reset
from ..operators import produce, visibility
from ..sources import codec
from ..sources.gateway import Gateway
from ..sources.shared import shared_dir
from ..sources.store import EventLog, produce_size
from ..streaming import queries as streams
from . import fixture as fx

TOPIC = "events"


def opened(spark: SparkSession, brokers: tuple[int, ...] = (1,), **config: int) -> EventLog:
    """An empty log in the shared folder; its clock stands still."""
    return EventLog(spark, f"{shared_dir(spark)}/log", LogConfig(**config), brokers=brokers, clock=lambda: 0)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as records in send order: keys as in the fixture's log, the event's id as value."""
    return fx.keyed(spark, sf_dir).select(
        F.col("key").cast("binary").alias("key"), F.col("event_id").cast("string").cast("binary").alias("value"), "timestamp_ms",
        F.array().cast("array<struct<key:string,value:binary>>").alias("headers"), F.lit(None).cast("int").alias("partition"), F.col("event_id").alias("send_seq"),
    )


def fetched(log: EventLog, isolation: Isolation = Isolation.READ_UNCOMMITTED) -> DataFrame:
    """part, off, event_id of all that a reader sees in all partitions."""
    parts = [log.fetch(TOPIC, p, log.describe_topic(TOPIC)[p]["start"], isolation=isolation) for p in range(log.partitions(TOPIC))]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.select(F.col("partition").cast("long").alias("part"), F.col("offset").alias("off"), F.col("value").cast("string").cast("long").alias("event_id"))


def store_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One append of all events, read again by another instance."""
    log = opened(spark)
    log.create_topic(TOPIC, fx.PARTITIONS)
    log.produce(TOPIC, records(spark, sf_dir))
    return fetched(EventLog(spark, log.catalog.root))


def store_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events outside of transactions, a third in one that commits, a third in one that aborts; then read_committed."""
    log, rows = opened(spark), records(spark, sf_dir).withColumn("partition", F.coalesce("partition", (F.col("send_seq") % fx.PARTITIONS).cast("int")))
    log.create_topic(TOPIC, fx.PARTITIONS)
    group = F.floor(F.col("send_seq") / 7) % 3
    log.produce(TOPIC, rows.where(group == 0))
    for kind, commit in ((1, True), (2, False)):
        log.begin(f"tx-{kind}")
        log.produce(TOPIC, rows.where(group == kind), transactional_id=f"tx-{kind}")
        log.end(f"tx-{kind}", commit)
    return fetched(log, Isolation.READ_COMMITTED)


def store_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events are copied, odd ones are not; the follower leads, and the producer's retry of the odd ones is appended again."""
    log, rows = opened(spark, (1, 2), replica_fetch_bytes=1 << 30), records(spark, sf_dir).withColumn("partition", F.lit(0))
    log.create_topic(TOPIC, 1, 2)
    me = log.allocate_producer("sender")
    even, odd = rows.where("send_seq % 2 = 0"), rows.where("send_seq % 2 = 1")
    first = log.produce(TOPIC, even, producer=me)[0]["records"]
    log.replicate(TOPIC, 0)
    log.produce(TOPIC, odd, producer=me, base_sequence=first)
    log.promote(TOPIC, 0, 2)
    log.produce(TOPIC, odd, producer=me, base_sequence=first)
    log.produce(TOPIC, odd, producer=me, base_sequence=first)  # a duplicate
    return fetched(log)


def store_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two closed segments and an active one, compacted: of each key the last, and all of the active segment."""
    log, rows = opened(spark), records(spark, sf_dir).withColumn("partition", F.lit(0))
    log.create_topic(TOPIC, 1)
    for i in range(3):
        log.produce(TOPIC, rows.where(F.floor(F.col("send_seq") / 10) % 3 == i))
        if i < 2:
            log.roll(TOPIC, 0)
    log.compact(TOPIC, 0, 1_000)
    return fetched(log)


def store_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three segments, of which one of the oldest leaves by size."""
    log, rows = opened(spark), records(spark, sf_dir).withColumn("partition", F.lit(0))
    log.create_topic(TOPIC, 1)
    for i in range(3):
        log.produce(TOPIC, rows.where(F.floor(F.col("send_seq") / 10) % 3 == i))
        log.roll(TOPIC, 0)
    log.produce(TOPIC, rows.where("send_seq < 3"))
    later = log.rows(TOPIC, 0).where(F.col("segment_base") > 0).agg(F.sum(produce_size())).first()[0]
    log.apply_retention(TOPIC, 0, retention_bytes=later)
    return fetched(log)


def store_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three members poll ten records each of what they own, and commit; then one leaves and another takes over, and the lag is told."""
    log = opened(spark)
    log.create_topic(TOPIC, fx.PARTITIONS)
    log.produce(TOPIC, records(spark, sf_dir))
    members = [log.consumer("readers", Reset.EARLIEST) for _ in range(3)]
    for m in members:
        m.subscribe([TOPIC])
    for m in members:
        m.refresh()
        m.poll(10)
        m.commit()
    members[1].close()
    rows = []
    for m in (members[0], members[2]):
        m.refresh()
        rows += [(m.member, p, m.position(t, p), m.lag(t, p)) for t, p in m.assigned]
    return spark.createDataFrame(rows, "member string, part long, position long, lag long")


def producer_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations sent one by one, by key or sticky, in batches; what each send was told, and what is in the log."""
    log = opened(spark)
    log.create_topic("nations", 2)
    p, sent = log.producer(batch_bytes=150, idempotent=True, name="nations"), []
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey")
    for r in nations.toLocalIterator():
        sent.append((r.n_nationkey, p.send("nations", key=None if r.n_nationkey % 5 == 0 else str(r.n_nationkey).encode(), value=r.n_name.encode(), partition=None if r.n_nationkey % 5 == 0 else r.n_nationkey % 2)))
    p.close()
    told = spark.createDataFrame([(k, s.result()["partition"], s.result()["offset"]) for k, s in sent], "nation long, part long, off long")
    read = log.fetch("nations", 0, 0).unionByName(log.fetch("nations", 1, 0))
    read = read.select(F.col("partition").cast("long").alias("part"), F.col("offset").alias("off"), F.col("value").cast("string").alias("name"))
    return told.join(read, ["part", "off"]).select("nation", "part", "name")


def gateway_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions produced and fetched by requests; each answer's records."""
    g = Gateway(opened(spark))
    g.dispatch({"operation": "create_topic", "topic": "regions", "partitions": 1, "replication_factor": 1})
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.base64(F.col("r_name").cast("binary")).alias("name")).orderBy("r_regionkey")
    for r in regions.toLocalIterator():
        g.dispatch({"operation": "produce", "topic": "regions", "value_b64": r.name})
    found = g.dispatch({"operation": "fetch", "topic": "regions", "partition": 0, "offset": 1})["records"]
    return spark.createDataFrame([(r["offset"], r["key_b64"], r["value_b64"]) for r in found], "off long, key_b64 string, value_b64 string")


def read_process_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events followed as a stream; what is made of each micro-batch and the offset behind it are published in one transaction, named by the micro-batch, so that one that comes again changes nothing."""
    log = opened(spark)
    log.create_topic("made", 2)

    def publish(rows: DataFrame, batch_id: int) -> None:
        txid = f"batch-{batch_id}"
        if log.catalog.load()["transactions"].get(txid, {}).get("state") == "complete_commit":
            return
        made = rows.where("event_type <> 'error'").select(
            F.lit(None).cast("binary").alias("key"), F.concat_ws("=", "event_type", "event_id").cast("binary").alias("value"), F.lit(0).cast("long").alias("timestamp_ms"),
            F.array().cast("array<struct<key:string,value:binary>>").alias("headers"), (F.col("event_id") % 2).cast("int").alias("partition"), F.col("event_id").alias("send_seq"))
        tx = log.begin(txid)
        log.produce("made", made, transactional_id=txid)
        tx.send_offsets("followers", {(TOPIC, 0): rows.agg(F.max("event_id")).first()[0] + 1})
        tx.commit()
        publish(rows, batch_id)

    streams.follow_transactionally(streams.followed(spark, f"{sf_dir}/events.parquet"), publish, shared_dir(spark))
    seen = log.fetch("made", 0, 0, isolation=Isolation.READ_COMMITTED).unionByName(log.fetch("made", 1, 0, isolation=Isolation.READ_COMMITTED))
    return seen.select(F.col("partition").cast("long").alias("part"), F.col("offset").alias("off"), F.col("value").cast("string").alias("made"), F.lit(log.committed("followers", TOPIC, 0)).cast("long").alias("committed"))


def codec_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch of the log encoded and decoded again: its frame's bytes, records, next offset, greatest time and the bytes of its values."""
    rows = fx.log(spark, sf_dir).select("partition", "base_offset", "last_offset_delta", "offset", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "timestamp_ms")
    rows = rows.repartition("partition", "base_offset").sortWithinPartitions("partition", "base_offset", "offset")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> tuple:
            raw = codec.encode(codec.Batch(tuple(codec.Record(k, v, t) for _, k, v, t in held), key[1], tuple(o - key[1] for o, *_ in held), key[2]))
            back = codec.decode(raw)
            return key[0], back.base_offset, len(raw), len(back.records), back.next_offset, back.max_timestamp_ms, sum(len(r.value or b"") for r in back.records)

        for part in parts:
            made = []
            for p, base, last, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (p, base, last) != key:
                    if held:
                        made.append(out())
                    key, held = (p, base, last), []
                held.append(row)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(out())], names=names)

    names = ["part", "base", "bytes", "records", "nxt", "mts", "value_bytes"]
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def index_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a sparse index: the first batch of each 2,000 bytes, and its position."""
    found = produce.sample_index(visibility.batches(fx.log(spark, sf_dir), F.col("size"), fx.GROUP), "bytes", 2_000, group=fx.GROUP)
    return found.select(F.col("partition").cast("long").alias("part"), F.col("base_offset").alias("base"), "position")


_SENT = """, sent_log AS (SELECT event_id, CASE WHEN e.k IS NULL THEN event_id % 3 ELSE h.c % 3 END AS part FROM keyed e LEFT JOIN h ON e.k = h.k),
placed AS (SELECT part, event_id, row_number() OVER (PARTITION BY part ORDER BY event_id) - 1 AS off FROM sent_log) """

QUERIES = {f.__name__: f for f in (store_fetch, store_transactions, store_failover, store_compaction, store_retention, store_group, producer_session, gateway_requests, read_process_write, codec_frames, index_samples)}

#: SQL behind the log's; True for what needs no log.
ORACLES: dict[str, tuple[str, bool]] = {
    "store_fetch": (_SENT + "SELECT part::BIGINT AS part, off::BIGINT AS off, event_id::BIGINT AS event_id FROM placed", False),
    "store_transactions": ("""WITH rows AS (SELECT event_id, event_id % 3 AS part, event_id // 7 % 3 AS kind FROM events),
      placed AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY kind, event_id) - 1 AS off FROM rows)
      SELECT part::BIGINT AS part, off::BIGINT AS off, event_id::BIGINT AS event_id FROM placed WHERE kind < 2""", True),
    "store_failover": ("SELECT 0::BIGINT AS part, row_number() OVER (ORDER BY event_id % 2, event_id) - 1 AS off, event_id::BIGINT AS event_id FROM events", True),
    "store_compaction": ("""WITH rows AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN user_id END AS k, event_id // 10 % 3 AS seg FROM events),
      placed AS (SELECT *, row_number() OVER (ORDER BY seg, event_id) - 1 AS off FROM rows)
      SELECT 0::BIGINT AS part, off, event_id::BIGINT AS event_id FROM (SELECT *, max(off) OVER (PARTITION BY k) AS last FROM placed) WHERE seg = 2 OR k IS NULL OR off = last""", True),
    "store_retention": ("""WITH rows AS (SELECT event_id, event_id // 10 % 3 AS seg FROM events UNION ALL SELECT event_id, 3 FROM events WHERE event_id < 3),
      placed AS (SELECT *, row_number() OVER (ORDER BY seg, event_id) - 1 AS off FROM rows)
      SELECT 0::BIGINT AS part, off, event_id::BIGINT AS event_id FROM placed WHERE seg > 0""", True),
    "store_group": (_SENT + """, ends AS (SELECT part, count(*) AS n, least(10, count(*)) AS taken FROM placed GROUP BY part)
      SELECT 'member-' || (CASE WHEN part % 2 = 0 THEN 1 ELSE 3 END) AS member, part::BIGINT AS part, taken::BIGINT AS position, (n - taken)::BIGINT AS lag FROM ends""", False),
    "producer_session": ("""WITH RECURSIVE rows AS (SELECT n_nationkey AS nation, n_name AS name, n_nationkey % 5 = 0 AS free, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE length(n_nationkey::VARCHAR) END + 39 + length(n_name) AS size FROM nation),
      steps AS (SELECT -1::BIGINT AS nation, 0::BIGINT AS part, 0::BIGINT AS sticky, 0::BIGINT AS a, 0::BIGINT AS b, false AS fa, false AS fb
        UNION ALL SELECT nation, part, CASE WHEN part = 0 AND a >= 150 AND fa AND sticky = 0 THEN 1 WHEN part = 1 AND b >= 150 AND fb AND sticky = 1 THEN 0 ELSE sticky END,
          CASE WHEN a >= 150 THEN 0 ELSE a END, CASE WHEN b >= 150 THEN 0 ELSE b END, fa AND a < 150, fb AND b < 150 FROM (
            SELECT r.nation::BIGINT AS nation, p AS part, s.sticky, s.a + CASE WHEN p = 0 THEN r.size ELSE 0 END AS a, s.b + CASE WHEN p = 1 THEN r.size ELSE 0 END AS b, s.fa OR r.free AND p = 0 AS fa, s.fb OR r.free AND p = 1 AS fb
            FROM steps s JOIN (SELECT * FROM rows) r ON r.nation = s.nation + 1 CROSS JOIN LATERAL (SELECT CASE WHEN r.free THEN s.sticky ELSE (r.nation % 2)::BIGINT END AS p)))
      SELECT nation, part, name FROM steps JOIN (SELECT nation::BIGINT AS nation, name FROM rows) USING (nation)""", True),
    "gateway_requests": ("SELECT off, NULL::VARCHAR AS key_b64, to_base64(encode(r_name)) AS value_b64 FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS off FROM region) WHERE off > 0", True),
    "read_process_write": ("""SELECT event_id % 2 AS part, row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) - 1 AS off, event_type || '=' || event_id AS made,
      (SELECT max(event_id) + 1 FROM events) AS committed FROM events WHERE event_type <> 'error'""", True),
    "codec_frames": ("""SELECT part::BIGINT AS part, (off - off % 16)::BIGINT AS base, (52 + sum(size - 39 + 22))::BIGINT AS bytes, count(*) AS records, max(off)::BIGINT + 1 AS nxt, max(timestamp_ms)::BIGINT AS mts,
      sum(coalesce(strlen(v), 0))::BIGINT AS value_bytes FROM log GROUP BY part, off - off % 16""", False),
    "index_samples": (""", pos AS MATERIALIZED (SELECT part, base, coalesce(sum(sz) OVER (PARTITION BY part ORDER BY base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM batch),
      jumps AS MATERIALIZED (SELECT part, base, min(base) OVER (PARTITION BY part ORDER BY position RANGE BETWEEN 2000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM pos),
      entries AS (WITH RECURSIVE e(part, base) AS (SELECT DISTINCT part, 0::BIGINT FROM pos UNION ALL SELECT j.part, j.nxt FROM e JOIN jumps j ON j.part = e.part AND j.base = e.base WHERE j.nxt IS NOT NULL) SELECT * FROM e)
      SELECT part::BIGINT AS part, base::BIGINT AS base, position FROM entries JOIN pos USING (part, base)""", False),
}
