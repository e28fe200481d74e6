"""Schemas of the log table and of the control tables."""

from __future__ import annotations

from pyspark.sql import types as T

HEADERS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))

RECORD = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()),
    T.StructField("timestamp_ms", T.LongType()), T.StructField("headers", HEADERS),
])

LOG = T.StructType([
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()),
    *RECORD.fields,
    T.StructField("base_offset", T.LongType()), T.StructField("last_offset_delta", T.IntegerType()),
    T.StructField("leader_epoch", T.LongType()), T.StructField("producer_id", T.LongType()),
    T.StructField("producer_epoch", T.IntegerType()), T.StructField("base_sequence", T.IntegerType()),
    T.StructField("transactional_id", T.StringType()), T.StructField("control", T.StringType()),
    T.StructField("segment_base", T.LongType()),
])

TXN_STATES = ("ongoing", "prepare_commit", "prepare_abort", "complete_commit", "complete_abort")
UNSTABLE = TXN_STATES[:3]
