"""Document quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, is_held_out

#: Labelled rows that the ranking is learned from, at most: those of the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
#: Preference pairs drawn from them.
PAIRS = 200_000
#: Kinds that the sequences of three bytes are hashed to.
KINDS = 128
#: Their weight beside the surface's features, and the bytes of a text that has half of it: of short texts they say little.
SEQUENCE_WEIGHT, SEQUENCE_BYTES = 0.3, 300
#: Documents at or above this score are predicted good.
CUT = 0.3

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_DIGIT = b"0123456789"
_PLAIN = b".,;:'\"()-?"
_SPACE = b" \t\r\n\x0b\x0c"
_RARE = bytes(b for b in range(0x21, 0x7F) if bytes([b]) not in {bytes([x]) for x in _UPPER + _LOWER[:26] + _DIGIT + _PLAIN})
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "plain_marks", "rare_marks", "exclamations", "bars", "repeats",
    "distinct", "top_word", "long_words", "lines", "equal_lines", "unlike_ends", "words_with_marks",
)


def sequences(text: bytes) -> np.ndarray:
    """Roots of the shares that each hashed kind of three bytes has in the whole text: what it is written with, whatever its form."""
    codes = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(codes) < 3:
        return np.zeros(KINDS)
    mixed = (codes[:-2] << np.uint32(16) | codes[1:-1] << np.uint32(8) | codes[2:]) * np.uint32(0x9E3779B1)
    return np.sqrt(np.bincount(mixed >> np.uint32(32 - KINDS.bit_length() + 1), minlength=KINDS) / len(mixed))


def features(text: bytes) -> np.ndarray:
    return np.concatenate([surface(text), sequences(text)])


def surface(text: bytes) -> list[float]:
    """Shares and counts of the whole text, in the order of FEATURES."""
    n = len(text) or 1
    gone = lambda kind: len(text) - len(text.translate(None, kind))
    words, lines = text.split(), text.split(b"\n")
    w = len(words) or 1
    counts = Counter(words)
    top = max(counts.values(), default=0)
    upper, lower = gone(_UPPER), gone(_LOWER)
    rare = gone(_RARE)
    marked = sum(1 for x, c in counts.items() for _ in range(c) if not x[-1:].isalnum() and x[-1] < 0x80 and x[-1:] not in b".,;:?'\")")
    return [
        np.log1p(len(text)), np.log1p(len(words)), min(40, (n - gone(_SPACE)) / w), upper / (upper + lower + 1), gone(_DIGIT) / n, gone(_PLAIN) / n,
        rare / n, text.count(b"!") / w, text.count(b"|") / w, sum(map(eq, words, words[1:])) / w, len(counts) / w, top / w if w > 20 else 0.0,
        sum(c for x, c in counts.items() if len(x) > 25) / w, len(lines) / w, 1 - len(set(lines)) / len(lines),
        float(bool(words) and text.rstrip()[-1:] not in b".!?"), marked / w,
    ]


def expanded(rows: np.ndarray) -> np.ndarray:
    """Features, those of the surface with their roots and their clipped forms: a linear score can then bend."""
    own = rows[:, : len(FEATURES)]
    return np.concatenate([rows, np.sqrt(np.abs(own)), np.minimum(own, 0.05), np.minimum(own, 0.3)], 1)


def standard(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = (expanded(rows) - mean) / scale
    size = np.expm1(rows[:, 0])
    x[:, len(FEATURES) : rows.shape[1]] *= (SEQUENCE_WEIGHT * size / (size + SEQUENCE_BYTES))[:, None]
    return x


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1: a logistic curve through CUT at the threshold quantile."""
        raw = standard(rows, self.mean, self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.cut) + np.log(CUT / (1 - CUT)), -40, 40)))


def rank(rows: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3) -> Ranking | None:
    """Weights that make label 1 win over label 0: logistic loss on feature differences of pairs, by Newton steps.

    The threshold is the quantile of the learned scores at the share of label
    0. None where there are not both labels.
    """
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return None
    x = expanded(rows)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = standard(rows, mean, scale)
    draw = np.random.default_rng(5)
    won, lost = draw.choice(good, pairs), draw.choice(bad, pairs)
    weights = np.zeros(x.shape[1])
    for _ in range(12):
        gram, slope = np.zeros((len(weights), len(weights))), np.zeros(len(weights))
        for i in range(0, pairs, 5_000):
            d = x[won[i : i + 5_000]] - x[lost[i : i + 5_000]]
            p = 1 / (1 + np.exp(-np.clip(d @ weights, -40, 40)))
            slope += d.T @ (1 - p)
            gram += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(gram / pairs + penalty * np.eye(len(weights)), slope / pairs - penalty * weights)
        weights += step
        if np.abs(step).max() < 1e-4:
            break
    raw = x @ weights
    cut = float(np.quantile(raw, (labels == 0).mean()))
    return Ranking(mean, scale, weights, cut, 4 / (raw.std() + 1e-9))


def _features(docs: DataFrame, *others: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_values(batch.column(0))
            rows = [features(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), *batch.columns[1:]], names=["features", *others])

    kinds = dict(docs.dtypes)
    schema = ", ".join(["features array<double>", *[f"{x} {kinds[x]}" for x in others]])
    return docs.select(F.col("text").cast("binary").alias("text"), *others).mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Ranking | None:
    """From labelled rows that are not held out; ``sample_rows`` of them at most, which bounds what is broadcast and collected."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = _features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "quality").toArrow()
    if not len(rows):
        return None
    flat = rows["features"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    return rank(flat, rows["quality"].to_numpy())


def score(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row, from the whole text alone.

    Defined cases: null texts count as empty, and empty ones are scored like
    others; with no ranking (not both labels seen) every score is 0.5; equal
    texts score the same, repeated rows are answered each; a null id is not
    held out; columns but doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = byte_values(batch.column(1))
            if model is None:
                values = np.full(len(batch), 0.5)
            elif len(batch):
                values = model.score(np.array([features(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]))
            else:
                values = np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
