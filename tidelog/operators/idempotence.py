"""Producer state: fencing, exact retries, sequence order. One step function serves batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACCEPTED, DUPLICATE, FENCED, OUT_OF_ORDER = "accepted", "duplicate", "fenced", "out_of_order"


class State(NamedTuple):
    """Of a producer in a partition: epoch, last batch's sequences, and its result."""

    epoch: int
    first: int
    last: int
    offset: int


def step(state: State | None, epoch: int, first: int, count: int, end: int) -> tuple[State | None, str, int | None]:
    """New state, verdict and base offset of a batch that would be appended at ``end``.

    An older epoch is fenced, a newer one starts at sequence 0. The latest
    batch sent again gets its first result; only that one is remembered.
    """
    if state and epoch < state.epoch:
        return state, FENCED, None
    last = first + count - 1
    if state and epoch == state.epoch and (first, last) == (state.first, state.last):
        return state, DUPLICATE, state.offset
    due = state.last + 1 if state and epoch == state.epoch else 0
    if first != due:
        return state, OUT_OF_ORDER, None
    return State(epoch, first, last, end), ACCEPTED, end


SCHEMA = "topic string, partition int, producer_id long, send_seq long, verdict string, result_offset long"


def run_state(rows: pd.DataFrame, state: State | None) -> tuple[pd.DataFrame, State | None]:
    out = []
    for r in rows.sort_values("send_seq").itertuples():
        state, verdict, offset = step(state, r.producer_epoch, r.base_sequence, r.records, r.send_seq)
        out.append((r.topic, r.partition, r.producer_id, r.send_seq, verdict, offset))
    made = pd.DataFrame(out, columns=["topic", "partition", "producer_id", "send_seq", "verdict", "result_offset"])
    made["result_offset"] = made["result_offset"].astype("Int64")
    return made, state


def validate(batches: DataFrame) -> DataFrame:
    """Verdicts of batches in send order: topic, partition, producer_id, send_seq, verdict, result_offset.

    The machine depends on every verdict before, so a producer's batches in a
    partition (a row a batch, not a record) go to one task; there they are
    sorted, spilling if need be, and one state is carried along.
    """
    names = ["topic", "partition", "producer_id", "send_seq", "producer_epoch", "base_sequence", "records"]
    rows = batches.select(*names).repartition("topic", "partition", "producer_id").sortWithinPartitions("topic", "partition", "producer_id", "send_seq")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for part in parts:
            topic, partition, producer, sent, epoch, first, count = (part.column(i).to_pylist() for i in range(7))
            verdicts, offsets = [], []
            for key, s, e, f, n in zip(zip(topic, partition, producer, strict=True), sent, epoch, first, count, strict=True):
                if key != last:
                    last, state = key, None
                state, verdict, offset = step(state, e, f, n, s)
                verdicts.append(verdict)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(verdicts, pa.string()), pa.array(offsets, pa.int64())], names=[*names[:4], "verdict", "result_offset"])

    return rows.mapInArrow(run, SCHEMA)


def sequence_gaps(batches: DataFrame) -> DataFrame:
    """Where a producer's sequence does not go on, in input without rejects: a window of one row back."""
    w = Window.partitionBy("topic", "partition", "producer_id", "producer_epoch").orderBy("send_seq")
    expected = F.coalesce(F.lag(F.col("base_sequence") + F.col("records")).over(w), F.lit(0))
    return batches.withColumn("expected", expected).where(F.col("base_sequence") != F.col("expected"))


def fenced(batches: DataFrame) -> DataFrame:
    """Batches of an epoch older than one seen before."""
    w = Window.partitionBy("topic", "partition", "producer_id").orderBy("send_seq").rowsBetween(Window.unboundedPreceding, -1)
    return batches.withColumn("__newest", F.max("producer_epoch").over(w)).where(F.col("producer_epoch") < F.col("__newest")).drop("__newest")


def exact_retries(batches: DataFrame) -> DataFrame:
    w = Window.partitionBy("topic", "partition", "producer_id").orderBy("send_seq")
    same = [F.col(c) == F.lag(c).over(w) for c in ("producer_epoch", "base_sequence", "records")]
    return batches.withColumn("__again", same[0] & same[1] & same[2]).where("__again").drop("__again")
