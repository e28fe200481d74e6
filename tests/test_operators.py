from __future__ import annotations

import bisect
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.config import Acks, LogConfig, ManualClock, checked_topic
from tidelog.errors import OffsetOutOfRange, StorageError
from tidelog.functions import scalars
from tidelog.operators import consume, idempotence, maintenance, produce, replication, transactions, visibility

LOG = "topic string, partition int, offset long, key binary, value binary, timestamp_ms long, segment_base long, base_offset long, last_offset_delta int, control string"


def log(spark, rows):
    """(offset, key, value, time, segment)"""
    b = lambda x: None if x is None else x.encode()
    return spark.createDataFrame([("t", 0, o, b(k), b(v), t, s, o, 0, None) for o, k, v, t, s in rows], LOG)


def offsets(df):
    return sorted(r.offset for r in df.collect())


def test_routing(spark):
    rows = spark.createDataFrame([(b"user seven",), (b"k\x00",), (b"",), (None,)], "key binary")
    assert [r.p for r in rows.select(scalars.keyed_partition("key", 3).alias("p")).collect()] == [zlib.crc32(b"user seven") % 3, zlib.crc32(b"k\x00") % 3, 0, None]


def test_keyless_sends_take_turns_and_explicit_partitions_win(spark):
    rows = spark.createDataFrame([(i, None, 2 if i == 3 else None) for i in range(5)], "seq long, key binary, want int")
    routed = produce.route(rows, 3, ["seq"], F.floor(F.col("seq") / 2), explicit="want")
    assert [r.partition for r in routed.orderBy("seq").collect()] == [0, 1, 2, 2, 1]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50)), max_size=40))
def test_dense_numbers_are_row_numbers(spark, rows):
    df = spark.createDataFrame([(g, o, i) for i, (g, o) in enumerate(rows)], "g int, o int, i int")
    got = {r.i: r.n for r in produce.dense_numbers(df, ["g"], ["o", "i"], F.floor(F.col("o") / 7), "n").collect()}
    for g in range(3):
        own = sorted((o, i) for i, (x, o) in enumerate(rows) if x == g)
        assert [got[i] for _, i in own] == list(range(len(own)))


def test_offsets_go_on_from_the_end(spark):
    ends = spark.createDataFrame([("t", 0, 7)], "topic string, partition int, leo long")
    rows = spark.createDataFrame([("t", 0, 1), ("t", 0, 2), ("t", 1, 3)], "topic string, partition int, seq long")
    assert sorted((r.partition, r.offset) for r in produce.assign_offsets(rows, ["seq"], F.lit(0), ends).collect()) == [(0, 7), (0, 8), (1, 0)]


def test_sizes(spark):
    r = spark.createDataFrame([(b"ab", None, [("h", b"xyz")])], "key binary, value binary, headers array<struct<key:string,value:binary>>")
    got = r.select(scalars.estimated_bytes("key", "value").alias("e"), scalars.record_bytes("key", "value", "headers").alias("b")).first()
    assert (got.e, got.b) == (41, 22 + 2 + 2 + 1 + 4 + 3)


def test_placement(spark):
    got = [r.x for r in spark.range(4).select(scalars.placed_replicas("id", [3, 1, 2], 2).alias("x")).collect()]
    assert got == [[1, 2], [2, 3], [3, 1], [1, 2]]
    with pytest.raises(ValueError):
        scalars.placed_replicas("id", [1], 2)


def test_fetch_bounds(spark):
    rows = log(spark, [(0, "a", "1", 0, 0), (1, "b", "1", 0, 0), (2, "c", "1", 0, 0)])
    assert offsets(visibility.fetch(rows, "t", 0, 0, end=2)) == [0, 1]
    assert offsets(visibility.fetch(rows, "t", 0, 3)) == []
    assert offsets(visibility.fetch(rows, "t", 0, 0, max_records=0)) == []  # K1: none, not all
    with pytest.raises(ValueError):
        visibility.fetch(rows, "t", 0, 0, max_records=-1)
    assert visibility.checked_range(3, 0, 3) == 3  # K2: the end is in range
    with pytest.raises(OffsetOutOfRange) as e:
        visibility.checked_range(4, 0, 3)
    assert (e.value.requested, e.value.start, e.value.end, e.value.code) == (4, 0, 3, "OFFSET_OUT_OF_RANGE")


def test_byte_budget_gives_one_batch_at_least(spark):
    b = spark.createDataFrame([("t", 0, 0, 1, 100), ("t", 0, 1, 2, 1)], "topic string, partition int, base_offset long, next_offset long, bytes long")
    assert [r.base_offset for r in visibility.read_batches(b, 0, 1).collect()] == [0]
    assert sorted(r.base_offset for r in visibility.read_batches(b, 0, 101).collect()) == [0, 1]


def test_compaction_keeps_latest_events_and_active(spark):
    rows = log(spark, [(0, "a", "1", 0, 0), (1, "b", "x", 1, 0), (2, "a", "2", 2, 2), (3, None, "event", 3, 2), (4, "active", "keep", 4, 4)])
    once = maintenance.compact(rows, 10, 1000)
    assert offsets(once) == [1, 2, 3, 4]
    assert offsets(maintenance.compact(once, 10, 1000)) == [1, 2, 3, 4]


def test_tombstones(spark):
    closed = [(0, "a", "1", 0, 0), (1, "a", None, 100, 0)]
    assert offsets(maintenance.compact(log(spark, [*closed, (2, "active", "x", 101, 2)]), 500, 1000)) == [1, 2]
    assert offsets(maintenance.compact(log(spark, [*closed, (2, "active", "x", 2000, 2)]), 2000, 1000)) == [2]
    assert offsets(maintenance.compact(log(spark, [*closed, (2, "active", "x", 2000, 2)]), 1100, 1000)) == [1, 2]  # K11: not over, just at
    assert offsets(maintenance.compact(log(spark, [(0, None, None, 0, 0), (1, "x", "1", 0, 1)]), 9999, 1)) == [0, 1]  # no key: no tombstone


def test_active_segment_is_whole_and_shadows(spark):
    rows = log(spark, [(0, "a", "old", 0, 0), (1, "a", "new", 1, 1), (2, "a", "newer", 2, 1)])
    assert offsets(maintenance.compact(rows, 5, 10)) == [1, 2]


def segs(spark, times, sizes=None):
    sizes = sizes or [10] * len(times)
    return spark.createDataFrame([("t", 0, i, t, s, i == len(times) - 1) for i, (t, s) in enumerate(zip(times, sizes))], "topic string, partition int, segment_base long, max_timestamp_ms long, bytes long, active boolean")


def test_retention(spark):
    gone = lambda df: sorted(r.segment_base for r in df.collect())
    assert gone(maintenance.retention(segs(spark, [0, 50, 150, 250]), 300, 100)) == [0, 1, 2]
    assert gone(maintenance.retention(segs(spark, [250, 0, 0, 250]), 300, 100)) == []
    assert gone(maintenance.retention(segs(spark, [0, 0, 0, 0]), 0, None, 20)) == [0, 1]
    assert gone(maintenance.retention(segs(spark, [0, 50, 150, 250]), 300, 100, 20)) == [0, 1, 2]
    with pytest.raises(StorageError):
        maintenance.checked_prefix([0, 1, 2], [1])


def test_truncate_at_boundaries_only(spark):
    rows = log(spark, [(0, "a", "1", 0, 0), (1, "b", "1", 0, 0), (2, "c", "1", 0, 0)]).withColumn("base_offset", F.when(F.col("offset") < 2, 0).otherwise(2).cast("long")).withColumn("last_offset_delta", F.when(F.col("offset") < 2, 1).otherwise(0))
    with pytest.raises(StorageError):
        maintenance.checked_boundary(rows, 1)
    maintenance.checked_boundary(rows, 2)
    assert offsets(maintenance.truncate(rows, 2)) == [0, 1]


def replicas(spark, *rows):
    return spark.createDataFrame([("t", 0, *r) for r in rows], "topic string, partition int, broker_id int, leo long, last_fetch_ms long, in_sync boolean, is_leader boolean, hw long, leader_epoch long")


def test_watermark_and_sync(spark):
    r = replicas(spark, (1, 10, 0, True, True, 4, 0), (2, 6, 0, True, False, 4, 0), (3, 3, 0, True, False, 4, 0))
    near = {x.broker_id: x.in_sync for x in replication.refresh_isr(r, 10, 5, 100).collect()}
    assert near == {1: True, 2: True, 3: False}
    assert replication.high_watermark(replication.refresh_isr(r, 10, 5, 100)).first().hw == 6
    assert replication.high_watermark(r, 8).first().hw == 8  # never falls
    assert replication.startup_watermark(r).first().hw == 3
    assert not replication.refresh_isr(r, 1000, 50, 100).where("broker_id = 2").first().in_sync


def test_failover(spark):
    r = replicas(spark, (1, 2, 0, True, True, 1, 0), (2, 1, 0, True, False, 1, 0))
    after = replication.rejoin(replication.promote(r, 2), 1)
    got = {x.broker_id: (x.leo, x.in_sync, x.is_leader, x.leader_epoch) for x in after.collect()}
    assert got == {1: (1, False, False, 1), 2: (1, True, True, 1)}


def test_ack_status(spark):
    r = replicas(spark, (1, 5, 0, True, True, 0, 0), (2, 3, 0, True, False, 0, 0))
    w = spark.createDataFrame([("t", 0, 3, [1, 2]), ("t", 0, 5, [1, 2]), ("t", 0, 5, [1])], "topic string, partition int, target long, isr array<int>")
    got = sorted((x.target, x.status) for x in replication.ack_status(w.limit(2), r, 2).collect())
    assert got == [(3, "done"), (5, "waiting")]
    assert replication.ack_status(w.limit(1), r, 3).first().status == "failed"


def test_round_robin(spark):
    parts = spark.createDataFrame([("orders", p) for p in range(4)] + [("none", 0)], "topic string, partition int")
    members = spark.createDataFrame([("orders", "b"), ("orders", "a")], "topic string, member_id string")
    got = sorted((r.partition, r.member_id) for r in consume.round_robin(parts, members).collect())
    assert got == [(0, "a"), (1, "b"), (2, "a"), (3, "b")]


def test_expiry_is_strict(spark):
    m = spark.createDataFrame([("a", 100), ("b", 99)], "member_id string, deadline_ms long")
    assert [r.member_id for r in consume.expired(m, 100).collect()] == ["b"]


def test_poll_is_greedy_and_positions_follow(spark):
    rows = log(spark, [(o, "k", "v", 0, 0) for o in range(3)]).unionByName(log(spark, [(o, "k", "v", 0, 0) for o in range(3)]).withColumn("partition", F.lit(1)))
    pos = spark.createDataFrame([("t", 0, 1), ("t", 1, 0)], "topic string, partition int, position long")
    ends = spark.createDataFrame([("t", 0, 3), ("t", 1, 2)], "topic string, partition int, hw long")
    polled = consume.poll(rows, pos, 3, ends)
    assert [(r.partition, r.offset) for r in polled.collect()] == [(0, 1), (0, 2), (1, 0)]
    assert {r.partition: r.position for r in consume.advanced(pos, polled).collect()} == {0: 3, 1: 1}
    assert {r.partition: r.lag for r in consume.consumer_lag(pos, ends).collect()} == {0: 2, 1: 2}


def test_last_commit_wins(spark):
    w = spark.createDataFrame([("g", "t", 0, 9, 1), ("g", "t", 0, 4, 2)], "group_id string, topic string, partition int, offset long, commit_seq long")
    assert consume.upserted(w).first().offset == 4  # K26


def test_journal(spark):
    j = spark.createDataFrame([("x", "ongoing", 1, True), ("x", "prepare_commit", 2, True), ("y", "ongoing", 3, True), ("x", "complete_abort", 4, False), ("z", "ongoing", 5, True)], "transactional_id string, state string, seq long, ok boolean")
    prefix = transactions.valid_prefix(j)
    assert prefix.count() == 3
    states = {r.transactional_id: r.state for r in transactions.recovered(transactions.latest_states(prefix)).collect()}
    assert states == {"x": "complete_commit", "y": "ongoing"}  # K5, K6


def test_unstable_above_watermark_does_not_widen(spark):
    rows = log(spark, [(0, "a", "1", 0, 0), (5, "b", "1", 0, 0)]).withColumn("transactional_id", F.when(F.col("offset") == 5, "x"))
    states = spark.createDataFrame([("x", "ongoing")], "transactional_id string, state string")
    hw = spark.createDataFrame([("t", 0, 3)], "topic string, partition int, hw long")
    assert visibility.last_stable(hw, rows, states).first().lso == 3  # K3


def test_producer_steps():
    state, verdict, offset = idempotence.step(None, 0, 0, 1, 10)
    assert (verdict, offset) == (idempotence.ACCEPTED, 10)
    assert idempotence.step(state, 0, 0, 1, 11)[1:] == (idempotence.DUPLICATE, 10)
    assert idempotence.step(state, 0, 2, 1, 11)[1] == idempotence.OUT_OF_ORDER
    state, verdict, _ = idempotence.step(state, 1, 0, 1, 11)
    assert verdict == idempotence.ACCEPTED
    assert idempotence.step(state, 0, 1, 1, 12)[1] == idempotence.FENCED


def test_folds(spark):
    rows = spark.createDataFrame([("t", 0, i, s) for i, s in enumerate([5, 5, 3, 20, 1])], "topic string, partition int, offset long, size long")
    assert [r.batch for r in produce.close_batches(rows, "size", 10).orderBy("offset").collect()] == [0, 0, 1, 1, 2]
    assert [r.segment for r in produce.roll_segments(rows, "size", 10, order="offset").orderBy("offset").collect()] == [0, 0, 1, 2, 3]


def test_index_floor_is_a_search(spark):
    rng = random.Random(4)
    entries = {p: sorted(rng.sample(range(500), 12)) for p in range(3)}
    index = spark.createDataFrame([("t", p, o, 10 * i) for p, own in entries.items() for i, o in enumerate(own)], "topic string, partition int, base_offset long, position long")
    wanted = [("t", p, o) for p in range(4) for o in rng.sample(range(520), 30)]
    got = {(r.partition, r.target): r.position for r in produce.index_floor(spark.createDataFrame(wanted, "topic string, partition int, target long"), index).collect()}
    assert got == {(p, o): 10 * max(0, bisect.bisect_right(entries.get(p, []), o) - 1) for _, p, o in wanted}


def test_sampled_index(spark):
    rng = random.Random(5)
    sizes = {p: [rng.randrange(1, 90) for _ in range(40)] for p in range(2)}
    rows = spark.createDataFrame([("t", p, 7 * i, s) for p, own in sizes.items() for i, s in enumerate(own)], "topic string, partition int, base_offset long, bytes long")
    got = sorted((r.partition, r.base_offset, r.position) for r in produce.sample_index(rows, "bytes", 100).collect())
    want = []
    for p, own in sizes.items():
        position, last = 0, None
        for i, s in enumerate(own):
            if last is None or position - last >= 100:
                want.append((p, 7 * i, position))
                last = position
            position += s
    assert got == want


def test_values():
    assert Acks.parse(-1) is Acks.parse("all") is Acks.ALL and Acks.parse(1) is Acks.LEADER
    with pytest.raises(ValueError):
        Acks.parse(2)
    with pytest.raises(ValueError):
        LogConfig(segment_max_bytes=0)
    for bad in ("", ".", "..", "a/b", "x" * 250):
        with pytest.raises(ValueError):
            checked_topic(bad)
    clock = ManualClock(5)
    assert clock.advance_ms(3) == 8
    with pytest.raises(ValueError):
        clock.advance_ms(-1)


def test_linger_and_buffer(spark):
    from tidelog import errors
    from tidelog.operators import produce

    waiting = spark.createDataFrame([("t", 0, 1, 100, 40), ("t", 0, 2, 50, 60), ("t", 1, 3, 91, 10), ("t", 2, 4, 90, 10)], "topic string, partition int, send_seq long, added_ms long, bytes long")
    assert sorted(r.partition for r in produce.due_partitions(waiting, 100, 10).collect()) == [2]
    assert sorted(r.partition for r in produce.due_partitions(waiting, 100, 0).collect()) == [0, 1, 2]
    assert produce.checked_buffer(waiting, 120) == 120 and produce.checked_buffer(waiting.limit(0), 0) == 0
    with pytest.raises(errors.ProducerBufferFull):
        produce.checked_buffer(waiting, 119)
