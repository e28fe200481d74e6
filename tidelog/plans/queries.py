"""Queries over the event log of ``fixture``, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..operators import consume, idempotence, maintenance, produce, replication, transactions, visibility
from ..streaming import queries as streams
from . import control
from . import fixture as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
G = fx.GROUP

# The log in SQL: CRC-32 by bits (keys are ASCII digits), offsets by send order.
_LOG = """
WITH keyed AS (
  SELECT event_id, ts,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(user_id AS varchar) END AS k,
    CASE WHEN event_type = 'error' THEN NULL ELSE props END AS v,
    epoch_us(ts)//1000 AS timestamp_ms,
    CASE WHEN event_id % 3 = 0 THEN concat('tx-', CAST(event_id//50 AS varchar)) END AS txid
  FROM events),
u AS (SELECT DISTINCT k FROM keyed WHERE k IS NOT NULL),
h AS (SELECT k, xor(list_reduce(
        list_transform(range(0, length(k)), lambda i: ord(substr(k, i+1, 1))::BIGINT),
        lambda c, b: list_reduce(list_transform(range(0,8), lambda z: z::BIGINT),
          lambda x, j: CASE WHEN (x & 1)=1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END,
          xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) AS c FROM u),
routed AS (SELECT e.*, CASE WHEN e.k IS NULL
    THEN (row_number() OVER (PARTITION BY CASE WHEN e.k IS NULL THEN 1 ELSE 0 END ORDER BY ts, event_id) - 1) % 3
    ELSE h.c % 3 END AS part FROM keyed e LEFT JOIN h ON e.k = h.k),
log AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY ts, event_id) - 1 AS off,
  39 + coalesce(length(k), 0) + coalesce(strlen(v), 0) AS size FROM routed),
now AS (SELECT max(timestamp_ms) AS now_ms FROM log),
txs AS (SELECT DISTINCT txid, CAST(substr(txid,4) AS int) n FROM log WHERE txid IS NOT NULL),
states AS (SELECT txid, n, CASE WHEN n*100 >= (SELECT max(n) FROM txs)*98 THEN 'ongoing'
  WHEN n % 5 = 3 THEN 'complete_abort' ELSE 'complete_commit' END st FROM txs),
leo AS (SELECT part, max(off)+1 leo FROM log GROUP BY part),
reps AS (SELECT part, 1 b, leo FROM leo UNION ALL SELECT part, 2, leo-7 FROM leo UNION ALL SELECT part, 3, leo-500 FROM leo),
isr AS (SELECT *, max(leo) OVER (PARTITION BY part) - leo <= 100 AND (b = 1 OR leo >= 0) AS in_sync FROM reps),
hw AS (SELECT part, greatest(0, min(leo) FILTER (in_sync)) hw FROM isr GROUP BY part),
lso AS (SELECT h.part, h.hw, least(h.hw, coalesce(min(CASE WHEN s.st='ongoing' THEN l.off END), h.hw)) lso
  FROM hw h LEFT JOIN log l ON l.part=h.part LEFT JOIN states s ON s.txid=l.txid GROUP BY h.part, h.hw),
batch AS (SELECT part, off - off % 16 AS base, max(off)+1 AS nxt, count(*) AS n, max(timestamp_ms) AS mts, sum(size)::BIGINT AS sz FROM log GROUP BY ALL),
segs AS (SELECT part, off - off % 256 AS sb, max(timestamp_ms) mts, sum(size)::BIGINT sz FROM log GROUP BY ALL),
segf AS (SELECT *, sb = max(sb) OVER (PARTITION BY part) AS active, sum(sz) OVER (PARTITION BY part) tot,
  coalesce(sum(sz) OVER (PARTITION BY part ORDER BY sb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) bef,
  min(CASE WHEN mts < (SELECT now_ms FROM now) - 1209600000 THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY sb ROWS UNBOUNDED PRECEDING) pre FROM segs),
comp AS (SELECT *, max(off) OVER (PARTITION BY part,k) mx, (off - off % 256) = max(off - off % 256) OVER (PARTITION BY part) act FROM log),
kept AS (SELECT * FROM comp WHERE act OR k IS NULL OR (off=mx AND NOT (v IS NULL AND (SELECT now_ms FROM now) - timestamp_ms > 86400000))),
journal AS (SELECT txid, n * 3 + i AS seq, n <> 77 AS ok, CASE i WHEN 0 THEN 'ongoing' WHEN 1 THEN replace(st, 'complete', 'prepare') ELSE st END AS state
  FROM states, range(3) r(i) WHERE st <> 'ongoing' OR i = 0),
sent AS (SELECT user_id % 3 AS part, user_id AS pid, event_id, event_id//5000 AS epoch, event_id % 3 + 1 AS records,
  coalesce(sum(event_id % 3 + 1) OVER (PARTITION BY user_id, event_id//5000 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seq FROM events)
"""


def query(sql: str | None, plain: bool = False) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if plain else _LOG + sql
        return f

    return register


def _out(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by name=type, or name='source:type'."""
    picked = []
    for name, spec in columns.items():
        source, kind = spec.split(":") if ":" in spec else (name, spec)
        picked.append(F.col(source).cast(kind).alias(name))
    return df.select(*picked)


@query("SELECT event_id::BIGINT AS event_id, part::BIGINT AS part FROM routed WHERE k IS NOT NULL")
def route_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.keyed(spark, sf_dir).where(F.col("key").isNotNull())
    return rows.select("event_id", scalars.keyed_partition("key", fx.PARTITIONS).cast("long").alias("part"))


@query("SELECT event_id::BIGINT AS event_id, part::BIGINT AS part FROM routed")
def route_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fx.routed(spark, sf_dir), event_id="long", part="partition:long")


@query("""SELECT n_nationkey::BIGINT AS part, r::BIGINT AS nth, ([1, 2, 3])[(n_nationkey + r) % 3 + 1]::BIGINT AS broker_id FROM nation, range(2) b(r)""", plain=True)
def replica_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = nations.select("n_nationkey", F.posexplode(scalars.placed_replicas("n_nationkey", [1, 2, 3], 2)).alias("nth", "broker_id"))
    return _out(rows, part="n_nationkey:long", nth="long", broker_id="long")


@query("SELECT part::BIGINT AS part, off::BIGINT AS off, event_id::BIGINT AS event_id FROM log")
def assign_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fx.numbered(spark, sf_dir), part="partition:long", off="offset:long", event_id="long")


@query("SELECT event_id::BIGINT AS event_id, size::BIGINT AS size FROM log")
def estimated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.keyed(spark, sf_dir).select("event_id", scalars.estimated_bytes("key", "value").alias("size"))


@query("SELECT part::BIGINT AS part, off - off % 16 AS base, (12 + 40 + sum(size - 39 + 22))::BIGINT AS bytes FROM log GROUP BY ALL")
def frame_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = scalars.record_bytes("key", "value")
    rows = fx.log(spark, sf_dir).groupBy("partition", "base_offset").agg((F.sum(each) + scalars.FRAME_BYTES + scalars.BATCH_BYTES).alias("bytes"))
    return _out(rows, part="partition:long", base="base_offset:long", bytes="long")


@query("""SELECT part::BIGINT AS part, off::BIGINT AS off, ((txid IS NOT NULL)::INT + CASE WHEN off % 97 = 0 AND txid IS NOT NULL THEN CASE WHEN off % 2 = 0 THEN 2 ELSE 4 END ELSE 0 END)::BIGINT AS flags FROM log""")
def batch_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.when((F.col("offset") % 97 == 0) & F.col("transactional_id").isNotNull(), F.when(F.col("offset") % 2 == 0, "commit").otherwise("abort"))
    rows = fx.log(spark, sf_dir).withColumn("flags", scalars.flags(F.col("transactional_id").isNotNull(), marker))
    return _out(rows, part="partition:long", off="offset:long", flags="long")


@query("SELECT part::BIGINT AS part, base, nxt, n AS records, mts, sz FROM batch")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visibility.batches(fx.log(spark, sf_dir), F.col("size"), G)
    return _out(rows, part="partition:long", base="base_offset:long", nxt="next_offset:long", records="long", mts="max_timestamp_ms:long", sz="bytes:long")


@query("SELECT part::BIGINT AS part, sb, lpad(sb::VARCHAR, 20, '0') AS stem, mts, sz, active FROM segf")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.segments(fx.log(spark, sf_dir)).withColumn("stem", scalars.segment_name("segment_base"))
    return _out(rows, part="partition:long", sb="segment_base:long", stem="string", mts="max_timestamp_ms:long", sz="bytes:long", active="boolean")


@query("SELECT part::BIGINT AS part, min(off - off % 256) AS start, max(off) + 1 AS leo FROM log GROUP BY part")
def log_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(visibility.log_ends(fx.log(spark, sf_dir), G), part="partition:long", start="long", leo="long")


@query("SELECT off::BIGINT AS off, event_id::BIGINT AS event_id, k, v, timestamp_ms FROM log WHERE part = 1 AND off >= 100 ORDER BY off LIMIT 50")
def fetch_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visibility.fetch(fx.log(spark, sf_dir), "events", 1, 100, max_records=50)
    return _out(rows, off="offset:long", event_id="long", k="key:string", v="value:string", timestamp_ms="long")


@query("""SELECT part::BIGINT AS part, base, running::BIGINT AS running FROM (SELECT *, sum(sz) OVER w AS running, row_number() OVER w AS rn FROM batch
  WHERE nxt > 100 WINDOW w AS (PARTITION BY part ORDER BY base ROWS UNBOUNDED PRECEDING)) WHERE running <= 20000 OR rn = 1""")
def fetch_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visibility.read_batches(visibility.batches(fx.log(spark, sf_dir), F.col("size"), G), 100, 20_000, group=G)
    return _out(rows, part="partition:long", base="base_offset:long", running="long")


@query(""", placed AS (SELECT part, base, coalesce(sum(sz) OVER (PARTITION BY part ORDER BY base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM batch),
entries AS (SELECT part, base, pos FROM placed WHERE base % 64 = 0)
SELECT p.part::BIGINT AS part, p.base + 5 AS target, max(e.pos)::BIGINT AS position FROM placed p JOIN entries e ON e.part = p.part AND e.base <= p.base + 5 GROUP BY ALL""")
def index_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visibility.batches(fx.log(spark, sf_dir), F.col("size"), G)
    before = Window.partitionBy("partition").orderBy("base_offset").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("position", F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("long"))
    found = produce.index_floor(placed.withColumn("target", F.col("base_offset") + 5), placed.where(F.col("base_offset") % 64 == 0), group=G)
    return _out(found, part="partition:long", target="long", position="long")


@query("SELECT part::BIGINT AS part, b::BIGINT AS broker_id, in_sync FROM isr")
def isr_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fx.replicas(fx.log(spark, sf_dir)), part="partition:long", broker_id="long", in_sync="boolean")


@query("SELECT part::BIGINT AS part, hw::BIGINT AS hw FROM hw")
def high_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fx.watermarks(fx.log(spark, sf_dir)), part="partition:long", hw="long")


@query("SELECT part::BIGINT AS part, min(leo)::BIGINT AS hw, count(*) FILTER (leo = l) AS in_sync FROM (SELECT *, max(leo) OVER (PARTITION BY part) l FROM reps) GROUP BY part")
def startup_hw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.replicas(fx.log(spark, sf_dir))
    alike = replication.startup_isr(rows, G).groupBy("partition").agg(F.count_if("in_sync").alias("in_sync"))
    return _out(replication.startup_watermark(rows, G).join(alike, "partition"), part="partition:long", hw="long", in_sync="long")


@query("""SELECT l.part::BIGINT AS part, l.leo - d AS target, CASE WHEN (SELECT count(*) FROM isr i WHERE i.part = l.part AND in_sync) < 2 THEN 'failed'
  WHEN d >= 7 THEN 'done' ELSE 'waiting' END AS status FROM leo l, (VALUES (0), (7), (20)) t(d)""")
def ack_all_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.replicas(fx.log(spark, sf_dir))
    targets = F.explode(F.array(*[F.col("leo") - d for d in (0, 7, 20)])).alias("target")
    waiters = rows.where("is_leader").select("partition", targets, F.array(F.lit(1), F.lit(2)).alias("isr"))
    return _out(replication.ack_status(waiters, rows, 2, G), part="partition:long", target="long", status="string")


@query("SELECT l.part::BIGINT AS part, off::BIGINT AS off, event_id::BIGINT AS event_id FROM log l JOIN hw USING (part) WHERE off < hw")
def read_uncommitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.log(spark, sf_dir)
    return _out(visibility.read_uncommitted(rows, fx.watermarks(rows), G), part="partition:long", off="offset:long", event_id="long")


@query("SELECT part::BIGINT AS part, txid, min(off)::BIGINT AS first FROM log WHERE txid IS NOT NULL GROUP BY ALL")
def txn_first_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(visibility.first_offsets(fx.log(spark, sf_dir), G), part="partition:long", txid="transactional_id:string", first="first_offset:long")


@query("SELECT part::BIGINT AS part, hw::BIGINT AS hw, lso::BIGINT AS lso FROM lso")
def last_stable_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.log(spark, sf_dir)
    return _out(visibility.last_stable(fx.watermarks(rows), rows, fx.states(spark, sf_dir), G), part="partition:long", hw="long", lso="long")


def _committed(spark: SparkSession, rows: DataFrame, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    states = fx.states(spark, sf_dir)
    return visibility.read_committed(source if source is not None else rows, states, visibility.last_stable(fx.watermarks(rows), rows, states, G), G)


@query("""SELECT l.part::BIGINT AS part, l.off::BIGINT AS off, l.event_id::BIGINT AS event_id FROM log l LEFT JOIN states s ON l.txid=s.txid JOIN lso o ON o.part=l.part
 WHERE l.off < o.lso AND (l.txid IS NULL OR s.st='complete_commit')""")
def read_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_committed(spark, fx.log(spark, sf_dir), sf_dir), part="partition:long", off="offset:long", event_id="long")


@query("""SELECT l.part::BIGINT AS part, l.off::BIGINT AS off, k, v FROM kept l LEFT JOIN states s ON l.txid=s.txid JOIN lso o ON o.part=l.part
 WHERE l.off < o.lso AND (l.txid IS NULL OR s.st='complete_commit')""")
def committed_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.log(spark, sf_dir)
    kept = maintenance.compact(rows, fx.latest_time(spark, sf_dir), fx.TOMBSTONE_MS, G)
    return _out(_committed(spark, rows, sf_dir, kept), part="partition:long", off="offset:long", k="key:string", v="value:string")


@query("SELECT st AS state, count(*) AS n FROM states GROUP BY st")
def txn_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = transactions.latest_states(fx.journal(spark, sf_dir))
    return latest.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT txid, seq::BIGINT AS seq, state FROM journal WHERE seq < coalesce((SELECT min(seq) FROM journal WHERE NOT ok), 1000000000000)")
def journal_valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(transactions.valid_prefix(fx.journal(spark, sf_dir)), txid="transactional_id:string", seq="long", state="string")


@query("""SELECT txid, replace(arg_max(state, seq), 'prepare', 'complete') AS state FROM journal
  WHERE seq <= (SELECT max(seq) - 50 FROM journal) GROUP BY txid""")
def txn_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = fx.journal(spark, sf_dir)
    cut = j.agg((F.max("seq") - 50).alias("cut"))
    early = j.crossJoin(F.broadcast(cut)).where(F.col("seq") <= F.col("cut"))
    return _out(transactions.recovered(transactions.latest_states(early)), txid="transactional_id:string", state="string")


@query("""SELECT 'workers' AS group_id, part::BIGINT AS part, arg_max(off, n)::BIGINT AS off FROM (
  SELECT l.part, l.txid, max(l.off) + 1 AS off, any_value(s.n) AS n FROM log l JOIN states s ON s.txid = l.txid WHERE st = 'complete_commit' GROUP BY l.part, l.txid) GROUP BY part""")
def txn_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = fx.states(spark, sf_dir)
    staged = fx.log(spark, sf_dir).where(F.col("transactional_id").isNotNull()).groupBy("transactional_id", "partition").agg((F.max("offset") + 1).alias("offset"))
    staged = staged.join(states.select("transactional_id", F.col("n").alias("seq")), "transactional_id").withColumns({"group_id": F.lit("workers"), "topic": F.lit("events")})
    return _out(transactions.published_offsets(staged, states), group_id="string", part="partition:long", off="offset:long")


@query("SELECT part::BIGINT AS part, off::BIGINT AS off, k, v FROM kept")
def compact_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = maintenance.compact(fx.log(spark, sf_dir), fx.latest_time(spark, sf_dir), fx.TOMBSTONE_MS, G)
    return _out(kept, part="partition:long", off="offset:long", k="key:string", v="value:string")


@query("SELECT part::BIGINT AS part, off::BIGINT AS off FROM comp WHERE k IS NULL OR off = mx AND NOT (v IS NULL AND (SELECT now_ms FROM now) - timestamp_ms > 86400000)")
def compact_tombstone_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = maintenance.compact(fx.log(spark, sf_dir), fx.latest_time(spark, sf_dir), fx.TOMBSTONE_MS, G, protect_active=False)
    return _out(kept, part="partition:long", off="offset:long")


@query("SELECT part::BIGINT AS part, count(*) AS before, (SELECT count(*) FROM kept k WHERE k.part = l.part) AS after FROM log l GROUP BY part")
def compact_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.log(spark, sf_dir)
    kept = maintenance.compact(rows, fx.latest_time(spark, sf_dir), fx.TOMBSTONE_MS, G).groupBy("partition").agg(F.count(F.lit(1)).alias("after"))
    return _out(rows.groupBy("partition").agg(F.count(F.lit(1)).alias("before")).join(kept, "partition"), part="partition:long", before="long", after="long")


@query("""SELECT part::BIGINT AS part, off::BIGINT AS off, (nx - off - 1)::BIGINT AS gap FROM (SELECT part, off, lead(off) OVER (PARTITION BY part ORDER BY off) AS nx FROM kept) WHERE nx - off > 1""")
def compact_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = maintenance.compact(fx.log(spark, sf_dir), fx.latest_time(spark, sf_dir), fx.TOMBSTONE_MS, G)
    rows = kept.withColumn("gap", F.lead("offset").over(Window.partitionBy("partition").orderBy("offset")) - F.col("offset") - 1).where(F.col("gap") > 0)
    return _out(rows, part="partition:long", off="offset:long", gap="long")


def _retained(spark: SparkSession, sf_dir: str, time: bool, size: bool) -> tuple[DataFrame, DataFrame]:
    segs = fx.segments(fx.log(spark, sf_dir))
    return segs, maintenance.retention(segs, fx.latest_time(spark, sf_dir), fx.RETENTION_MS if time else None, fx.RETENTION_BYTES if size else None, G)


@query("SELECT part::BIGINT AS part, sb FROM segf WHERE NOT active AND pre=1")
def retain_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_retained(spark, sf_dir, True, False)[1], part="partition:long", sb="segment_base:long")


@query("SELECT part::BIGINT AS part, sb FROM segf WHERE NOT active AND tot - bef > 40000")
def retain_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_retained(spark, sf_dir, False, True)[1], part="partition:long", sb="segment_base:long")


@query("SELECT part::BIGINT AS part, sb FROM segf WHERE NOT active AND (pre=1 OR tot - bef > 40000)")
def retain_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_retained(spark, sf_dir, True, True)[1], part="partition:long", sb="segment_base:long")


@query("SELECT part::BIGINT AS part, min(sb) AS start FROM segf WHERE active OR NOT (pre=1 OR tot - bef > 40000) GROUP BY part")
def log_start_after_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(maintenance.log_start(*_retained(spark, sf_dir, True, True), G), part="partition:long", start="log_start:long")


@query("SELECT l.part::BIGINT AS part, max(off)::BIGINT AS last, count(*) AS n FROM log l JOIN batch b ON b.part = l.part AND b.base = l.off - l.off % 16 WHERE b.nxt <= 160 GROUP BY ALL")
def truncate_to_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = maintenance.truncate(fx.log(spark, sf_dir), 160, G)
    return rows.groupBy(F.col("partition").cast("long").alias("part")).agg(F.max("offset").alias("last"), F.count(F.lit(1)).alias("n"))


def _with_hw(rows: DataFrame) -> DataFrame:
    return fx.replicas(rows).drop("hw").join(fx.watermarks(rows), "partition")


@query("SELECT part::BIGINT AS part, b::BIGINT AS broker_id, CASE WHEN b = 2 THEN least(leo, hw) ELSE leo END::BIGINT AS leo, b = 2 AS in_sync, 1::BIGINT AS leader_epoch FROM reps JOIN hw USING (part)")
def promote_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(replication.promote(_with_hw(fx.log(spark, sf_dir)), 2, G), part="partition:long", broker_id="long", leo="long", in_sync="boolean", leader_epoch="long")


@query("SELECT part::BIGINT AS part, b::BIGINT AS broker_id, CASE WHEN b = 1 THEN least(leo, hw) ELSE leo END::BIGINT AS leo, b = 2 AS in_sync FROM reps JOIN hw USING (part)")
def rejoin_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    promoted = replication.promote(_with_hw(fx.log(spark, sf_dir)), 2, G)
    return _out(replication.rejoin(promoted, 1, G), part="partition:long", broker_id="long", leo="long", in_sync="boolean")


@query("SELECT part::BIGINT AS part, off::BIGINT AS off FROM log JOIN hw USING (part) WHERE off >= hw")
def divergent_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.log(spark, sf_dir)
    return _out(replication.divergent(rows, fx.watermarks(rows), G), part="partition:long", off="offset:long")


@query("SELECT r.part::BIGINT AS part, b::BIGINT AS broker_id, count(*) AS n, sum(sz)::BIGINT AS sz FROM reps r JOIN batch USING (part) WHERE b > 1 AND nxt > r.leo GROUP BY ALL")
def follower_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.log(spark, sf_dir)
    due = replication.pending(visibility.batches(rows, F.col("size"), G), fx.replicas(rows).where("NOT is_leader"), G)
    return due.groupBy(F.col("partition").cast("long").alias("part"), F.col("broker_id").cast("long").alias("broker_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").cast("long").alias("sz"))


# Regions are topics, their nations partitions; seven members subscribe to the regions of their suppliers.
_MEMBERS = """parts(topic, pt) AS (SELECT r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 > 0 UNION ALL SELECT 'unread', 0),
sells AS (SELECT DISTINCT r_name AS topic, n_nationkey AS pt, 's' || (s_suppkey % 7) AS mem FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
mem AS (SELECT DISTINCT topic, mem FROM sells),
dealt AS (SELECT p.topic, p.pt, m.mem FROM (SELECT topic, pt, row_number() OVER (ORDER BY topic, pt) - 1 AS cur, n
   FROM (SELECT x.topic, x.pt, (SELECT count(*) FROM mem y WHERE y.topic = x.topic) AS n FROM parts x) q WHERE n > 0) p
 JOIN (SELECT topic, mem, row_number() OVER (PARTITION BY topic ORDER BY mem) - 1 AS rk FROM mem) m ON m.topic = p.topic AND m.rk = p.cur % p.n)"""


def _group(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nations = read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("topic"), F.col("n_nationkey").alias("partition"))
    parts = nations.where("partition % 6 > 0").unionByName(spark.createDataFrame([("unread", 0)], "topic string, partition int"))
    sells = read("supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("partition"))
    sells = sells.select("topic", "partition", F.concat(F.lit("s"), F.col("s_suppkey") % 7).alias("member_id")).distinct()
    return parts, sells.select("topic", "member_id").distinct(), sells


@query(f"WITH {_MEMBERS} SELECT topic, pt::BIGINT AS part, mem AS member_id FROM dealt", plain=True)
def assign_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, members, _ = _group(spark, sf_dir)
    return _out(consume.round_robin(parts, members), topic="string", part="partition:long", member_id="string")


@query(f"WITH {_MEMBERS} SELECT topic, pt::BIGINT AS part, mem AS member_id FROM sells EXCEPT SELECT topic, pt, mem FROM dealt", plain=True)
def ownership_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, members, sells = _group(spark, sf_dir)  # every member commits where it has a supplier
    return _out(consume.not_owned(sells, consume.round_robin(parts, members)), topic="string", part="partition:long", member_id="string")


@query("SELECT user_id::BIGINT AS member_id FROM (SELECT user_id, max(timestamp_ms) m FROM (SELECT user_id, epoch_us(ts)//1000 AS timestamp_ms FROM events) GROUP BY 1) WHERE (SELECT now_ms FROM now) > m + 10000000")
def expired_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = fx.events(spark, sf_dir).groupBy(F.col("user_id").alias("member_id")).agg((F.max(F.unix_millis(F.col("ts").cast("timestamp"))) + 10_000_000).alias("deadline_ms"))
    return _out(consume.expired(seen, fx.latest_time(spark, sf_dir)), member_id="long")


def _positions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("partition").agg((F.max("offset") + 1 - 10 * (F.col("partition") + 1)).alias("position"))


@query("SELECT part::BIGINT AS part, CASE WHEN part = 1 THEN 40 ELSE hw END::BIGINT AS position FROM hw")
def initial_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.log(spark, sf_dir)
    bounds = visibility.log_ends(rows, G).select("partition", "start").join(fx.watermarks(rows), "partition")
    committed = spark.createDataFrame([(1, 40)], "partition int, offset long")
    found = consume.initial_positions(rows.select("partition").distinct(), committed, bounds, "latest", G)
    return _out(found, part="partition:long", position="long")


@query("SELECT part::BIGINT AS part, greatest(0, hw - (leo - 10 * (part + 1)))::BIGINT AS lag FROM hw JOIN leo USING (part)")
def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.log(spark, sf_dir)
    return _out(consume.consumer_lag(_positions(rows), fx.watermarks(rows), G), part="partition:long", lag="long")


_POLL = """, polled AS (SELECT l.part, off, event_id FROM log l JOIN hw USING (part) JOIN leo USING (part) WHERE off >= leo - 10 * (l.part + 1) AND off < hw ORDER BY l.part, off LIMIT 12) """


@query(_POLL + "SELECT part::BIGINT AS part, off::BIGINT AS off, event_id::BIGINT AS event_id FROM polled")
def poll_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.log(spark, sf_dir)
    return _out(consume.poll(rows, _positions(rows), 12, fx.watermarks(rows), G), part="partition:long", off="offset:long", event_id="long")


@query(_POLL + "SELECT l.part::BIGINT AS part, coalesce((SELECT max(off) + 1 FROM polled p WHERE p.part = l.part), leo - 10 * (l.part + 1))::BIGINT AS position FROM leo l")
def poll_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.log(spark, sf_dir)
    polled = consume.poll(rows, _positions(rows), 12, fx.watermarks(rows), G)
    return _out(consume.advanced(_positions(rows), polled, G), part="partition:long", position="long")


@query("SELECT user_id::BIGINT AS member_id, arg_max(event_id % 97, event_id)::BIGINT AS off FROM events GROUP BY 1", plain=True)
def offsets_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = fx.events(spark, sf_dir).select(F.col("user_id").alias("member_id"), (F.col("event_id") % 97).alias("offset"), F.col("event_id").alias("commit_seq"))
    return _out(consume.upserted(writes, ["member_id"]), member_id="long", off="offset:long")


@query("""SELECT part::BIGINT AS part, pid::BIGINT AS producer_id, event_id * 2 + r AS send_seq, CASE r WHEN 0 THEN 'accepted' ELSE 'duplicate' END AS verdict,
  (event_id * 2)::BIGINT AS result_offset FROM sent, range(2) t(r) WHERE r = 0 OR event_id % 7 = 0""")
def dedup_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = idempotence.validate(fx.with_retries(fx.sent_batches(spark, sf_dir)))
    return _out(found, part="partition:long", producer_id="long", send_seq="long", verdict="string", result_offset="long")


@query("SELECT pid::BIGINT AS producer_id, event_id * 2 + 1 AS send_seq FROM sent WHERE event_id % 7 = 0")
def dedup_exact_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(idempotence.exact_retries(fx.with_retries(fx.sent_batches(spark, sf_dir))), producer_id="long", send_seq="long")


@query("""SELECT pid::BIGINT AS producer_id, event_id * 2 AS send_seq, due::BIGINT AS expected FROM (SELECT *, coalesce(lag(seq + records) OVER (PARTITION BY pid, epoch ORDER BY event_id), 0) AS due
  FROM sent WHERE event_id % 11 <> 0) WHERE seq <> due""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.sent_batches(spark, sf_dir).where(F.col("event_id") % 11 != 0)
    return _out(idempotence.sequence_gaps(rows), producer_id="long", send_seq="long", expected="long")


@query("""SELECT pid::BIGINT AS producer_id, event_id * 2 AS send_seq FROM (SELECT *, epoch - (event_id % 13 = 0)::INT AS e FROM sent) QUALIFY e < max(e) OVER
  (PARTITION BY pid ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def fenced_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.sent_batches(spark, sf_dir).withColumn("producer_epoch", F.col("producer_epoch") - (F.col("event_id") % 13 == 0).cast("int"))
    return _out(idempotence.fenced(rows), producer_id="long", send_seq="long")


def _fold_sql(limit: int, column: str) -> str:
    total = f"w.total + n.{column}"
    return f""" SELECT part::BIGINT AS part, nth::BIGINT AS nth, no::BIGINT AS no FROM (
  WITH RECURSIVE w(part, nth, total, no) AS (SELECT part, nth, {column}, 0 FROM nums WHERE nth = 0
    UNION ALL SELECT n.part, n.nth, CASE WHEN {total} > {limit} THEN n.{column} ELSE {total} END, w.no + ({total} > {limit})::INT
    FROM w JOIN nums n ON n.part = w.part AND n.nth = w.nth + 1) SELECT * FROM w)"""


@query(""", sums AS (SELECT part, off, size, sum(size) OVER (PARTITION BY part ORDER BY off) AS done FROM log),
jumps AS MATERIALIZED (SELECT part, off, min(off) OVER (PARTITION BY part ORDER BY done RANGE BETWEEN greatest(0, 1000 - size) FOLLOWING AND UNBOUNDED FOLLOWING) + 1 AS nxt FROM sums)
SELECT l.part::BIGINT AS part, l.off::BIGINT AS nth, sum((s.off IS NOT NULL)::INT) OVER (PARTITION BY l.part ORDER BY l.off)::BIGINT - 1 AS no FROM log l LEFT JOIN (
  WITH RECURSIVE starts(part, off) AS (SELECT DISTINCT part, 0::BIGINT FROM log
    UNION ALL SELECT s.part, j.nxt FROM starts s JOIN jumps j ON j.part = s.part AND j.off = s.off) SELECT * FROM starts) s
  ON l.part = s.part AND l.off = s.off""")
def batch_close_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    # in SQL: where each possible batch would close, then from one batch's end to the next
    found = produce.close_batches(fx.log(spark, sf_dir), "size", 1000, group=G)
    return _out(found, part="partition:long", nth="offset:long", no="batch:long")


@query(", nums AS (SELECT part, base // 16 AS nth, sz AS size FROM batch)" + _fold_sql(8000, "size"))
def segment_roll_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visibility.batches(fx.log(spark, sf_dir), F.col("size"), G).withColumn("nth", (F.col("base_offset") / 16).cast("long"))
    return _out(produce.roll_segments(rows, "bytes", 8000, order="nth", group=G), part="partition:long", nth="long", no="segment:long")


@query("SELECT event_id::BIGINT AS event_id, to_base64(encode(v)) AS wire, v AS back FROM log")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.keyed(spark, sf_dir).withColumn("wire", F.base64(F.col("value").cast("binary")))
    return rows.select("event_id", "wire", F.unbase64("wire").cast("string").alias("back"))


@query("""SELECT 'output' AS kind, part::BIGINT AS part, count(*) AS n FROM log JOIN hw USING (part) WHERE off < hw AND v IS NOT NULL GROUP BY part
  UNION ALL SELECT 'offset', part, hw FROM hw""")
def rpw_output_and_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.log(spark, sf_dir)
    hw = fx.watermarks(rows)
    seen = visibility.read_uncommitted(rows, hw, G).where(F.col("value").isNotNull()).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    both = seen.select(F.lit("output").alias("kind"), "partition", "n").unionByName(hw.select(F.lit("offset").alias("kind"), "partition", F.col("hw").alias("n")))
    return _out(both, kind="string", part="partition:long", n="long")


@query("SELECT event_id::BIGINT AS event_id, part::BIGINT AS part FROM routed WHERE k IS NOT NULL")
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tail(spark, f"{sf_dir}/events.parquet", fx.PARTITIONS)


@query("""SELECT part::BIGINT AS part, pid::BIGINT AS producer_id, event_id * 2 + r AS send_seq, CASE r WHEN 0 THEN 'accepted' ELSE 'duplicate' END AS verdict,
  (event_id * 2)::BIGINT AS result_offset FROM sent, range(2) t(r) WHERE r = 0 OR event_id % 7 = 0""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.dedup(spark, fx.with_retries(fx.sent_batches(spark, sf_dir)))
    return _out(found, part="partition:long", producer_id="long", send_seq="long", verdict="string", result_offset="long")


@query("""SELECT user_id::BIGINT AS member_id, min(ts)::TIMESTAMP AS first, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events))
  GROUP BY user_id, s""", plain=True)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(fx.events(spark, sf_dir), "6 hours")


@query("""SELECT member_id, first, n FROM (SELECT user_id::BIGINT AS member_id, min(ts)::TIMESTAMP AS first, max(ts) AS last, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events))
  GROUP BY user_id, s) WHERE last + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""", plain=True)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.closed_sessions(spark, f"{sf_dir}/events.parquet", "6 hours", "1 hour")


QUERIES |= control.QUERIES
ORACLES |= {name: sql if plain else _LOG + sql for name, (sql, plain) in control.ORACLES.items()}
