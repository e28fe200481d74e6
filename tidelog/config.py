"""Defaults and their validation; topic names; time as a value."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from enum import Enum

_TOPIC = re.compile(r"[A-Za-z0-9._-]{1,249}")


@dataclass(frozen=True)
class LogConfig:
    # The defaults that results are compared at.
    segment_max_bytes: int = 1_048_576
    index_interval_bytes: int = 4_096
    session_timeout_ms: int = 10_000
    replica_lag_offsets: int = 10_000
    replica_lag_ms: int = 10_000
    replica_fetch_bytes: int = 1_048_576
    min_insync_replicas: int = 1

    def __post_init__(self) -> None:
        for f in fields(self):
            least = 0 if f.name.startswith("replica_lag") else 1
            if getattr(self, f.name) < least:
                raise ValueError(f"{f.name} must be at least {least}")


def checked_topic(name: str) -> str:
    if not _TOPIC.fullmatch(name) or name in (".", ".."):
        raise ValueError(f"not a topic name: {name!r}")
    return name


class Acks(Enum):
    NONE, LEADER, ALL = "0", "1", "all"

    @classmethod
    def parse(cls, value: object) -> Acks:
        """0, 1, all, or -1 for all, as text or number."""
        text = str(value.value if isinstance(value, cls) else value)
        return cls.ALL if text == "-1" else cls(text)


class Isolation(Enum):
    READ_UNCOMMITTED, READ_COMMITTED = "read_uncommitted", "read_committed"


class Reset(Enum):
    EARLIEST, LATEST, ERROR = "earliest", "latest", "error"


class ManualClock:
    """Milliseconds that go on only when told to, never back."""

    def __init__(self, now_ms: int = 0) -> None:
        self.now_ms = now_ms

    def advance_ms(self, by: int) -> int:
        if by < 0:
            raise ValueError("time does not go back")
        self.now_ms += by
        return self.now_ms
