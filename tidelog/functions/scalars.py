"""Scalar expressions: routing, sizes, placement, positions. All are built-in functions, so plans stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a frame, of a batch and of a record, and what a record is taken to need besides key and value.
FRAME_BYTES, BATCH_BYTES, RECORD_BYTES, ESTIMATE_BYTES = 12, 40, 22, 39


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def size_of(x: Column | str) -> Column:
    """Bytes of a value, 0 if null."""
    return F.coalesce(F.length(_col(x).cast("binary")), F.lit(0)).cast("long")


def keyed_partition(key: Column | str, partitions: int) -> Column:
    """CRC-32 of the key's bytes, modulo the partitions; null for a null key."""
    return (F.crc32(_col(key).cast("binary")) % partitions).cast("int")


def estimated_bytes(key: Column | str, value: Column | str) -> Column:
    """What a record counts in a producer's buffer; headers count nothing."""
    return F.lit(ESTIMATE_BYTES) + size_of(key) + size_of(value)


def record_bytes(key: Column | str, value: Column | str, headers: Column | str | None = None) -> Column:
    """Exact encoded bytes of a record."""
    total = F.lit(RECORD_BYTES) + size_of(key) + size_of(value)
    if headers is not None:
        each = lambda n, h: n + 6 + size_of(h["key"]) + size_of(h["value"])
        total = total + F.coalesce(F.aggregate(_col(headers), F.lit(0).cast("long"), each), F.lit(0))
    return total


def placed_replicas(partition: Column | str, brokers: list[int], factor: int) -> Column:
    """Replica r of partition p is on broker (p + r) modulo the brokers; the first leads."""
    if not 1 <= factor <= len(brokers):
        raise ValueError("replication factor must be between 1 and the number of brokers")
    ring = F.array(*[F.lit(b) for b in sorted(brokers)])
    return F.transform(F.sequence(F.lit(0), F.lit(factor - 1)), lambda r: F.element_at(ring, ((_col(partition) + r) % len(brokers) + 1).cast("int")))


def segment_name(base: Column | str) -> Column:
    return F.format_string("%020d", _col(base).cast("long"))


def lag(end: Column | str, position: Column | str) -> Column:
    return F.greatest(F.lit(0).cast("long"), _col(end) - _col(position))


def batch_next_offset(base: Column | str, last_delta: Column | str) -> Column:
    return _col(base) + _col(last_delta) + 1


def flags(transactional: Column, control: Column) -> Column:
    """Bit 0: in a transaction; 1: commit marker; 2: abort marker."""
    return transactional.cast("int") + F.when(control == "commit", 2).when(control == "abort", 4).otherwise(0)


def is_tombstone(key: Column | str, value: Column | str) -> Column:
    return _col(key).isNotNull() & _col(value).isNull()
