"""Errors with stable codes, raised on the driver."""

from __future__ import annotations


class EventLogError(Exception):
    code = "EVENTLOG_ERROR"


class OffsetOutOfRange(EventLogError):
    code = "OFFSET_OUT_OF_RANGE"

    def __init__(self, requested: int, start: int, end: int) -> None:
        super().__init__(f"offset {requested} is outside of [{start}, {end}]")
        self.requested, self.start, self.end = requested, start, end


class OutOfOrderSequence(EventLogError):
    code = "OUT_OF_ORDER_SEQUENCE"

    def __init__(self, expected: int, actual: int) -> None:
        super().__init__(f"sequence {actual} came where {expected} was due")
        self.expected, self.actual = expected, actual


def _coded(name: str, code: str) -> type[EventLogError]:
    return type(name, (EventLogError,), {"code": code, "__module__": __name__})


# The codes are part of the interface.
InvalidRecord = _coded("InvalidRecord", "INVALID_RECORD")
CorruptBatch = _coded("CorruptBatch", "CORRUPT_BATCH")
CorruptIndex = _coded("CorruptIndex", "CORRUPT_INDEX")
StorageError = _coded("StorageError", "STORAGE_ERROR")
TopicAlreadyExists = _coded("TopicAlreadyExists", "TOPIC_ALREADY_EXISTS")
UnknownTopic = _coded("UnknownTopic", "UNKNOWN_TOPIC")
UnknownPartition = _coded("UnknownPartition", "UNKNOWN_PARTITION")
ProducerBufferFull = _coded("ProducerBufferFull", "PRODUCER_BUFFER_FULL")
RebalanceInProgress = _coded("RebalanceInProgress", "REBALANCE_IN_PROGRESS")
IllegalGeneration = _coded("IllegalGeneration", "ILLEGAL_GENERATION")
NotPartitionOwner = _coded("NotPartitionOwner", "NOT_PARTITION_OWNER")
UnknownMember = _coded("UnknownMember", "UNKNOWN_MEMBER")
NotEnoughReplicas = _coded("NotEnoughReplicas", "NOT_ENOUGH_REPLICAS")
NotEnoughReplicasAfterAppend = _coded("NotEnoughReplicasAfterAppend", "NOT_ENOUGH_REPLICAS_AFTER_APPEND")
NotInSyncReplica = _coded("NotInSyncReplica", "NOT_IN_SYNC_REPLICA")
FencedLeaderEpoch = _coded("FencedLeaderEpoch", "FENCED_LEADER_EPOCH")
ProducerFenced = _coded("ProducerFenced", "PRODUCER_FENCED")
InvalidRequest = _coded("InvalidRequest", "INVALID_REQUEST")
FrameTooLarge = _coded("FrameTooLarge", "FRAME_TOO_LARGE")
