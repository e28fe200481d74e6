"""SentencePiece encoding and decoding by a streaming lattice search."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, chunks

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Words, and pairs of pieces, that a task remembers before it forgets all and begins anew (about 225 MB and 30 MB).
MEMORY = 1_000_000
PAIR_MEMORY = 500_000
_SPACE = "▁"
_WORD = re.compile(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Pieces:
    """What a model file holds, and the search over it."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]
    rule: int
    byte_fallback: bool
    dummy_prefix: bool
    ids: dict[str, int] = field(default_factory=dict)
    words: dict[str, bytes] = field(default_factory=dict)
    memory: int = MEMORY
    fits: dict[str, dict[str, bool]] = field(default_factory=dict)
    pairs: int = 0
    tree: dict[str, tuple] = field(default_factory=dict)

    @classmethod
    def parse(cls, model: bytes) -> Pieces:
        texts, scores, kinds = [], [], []
        trainer: dict[int, int | bytes] = {}
        normal: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                texts.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without a normaliser are supported")
        out = cls(texts, scores, kinds, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(normal.get(3, 1)))
        out.ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k not in (_UNKNOWN, _CONTROL, _BYTE)}
        return out

    def __post_init__(self) -> None:
        self.longest = max((len(t) for t, k in zip(self.texts, self.kinds, strict=True) if k == _NORMAL), default=1)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == _BYTE}
        self.unknown = self.kinds.index(_UNKNOWN) if _UNKNOWN in self.kinds else 0
        self.missing = min(self.scores, default=0.0) - 10
        parts = [bytes([int(t[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else t.encode() for t, k in zip(self.texts, self.kinds, strict=True)]
        if _UNKNOWN in self.kinds:
            parts[self.unknown] = " ⁇ ".encode()
        self.plain = parts
        self.whole_words = not any(_SPACE in t.lstrip(_SPACE) for t, k in zip(self.texts, self.kinds, strict=True) if k == _NORMAL)

    def merged(self, text: str) -> list[str]:
        """BPE by definition: join the neighbours of the best score, leftmost first, until none are left."""
        out = list(text)
        while True:
            best, at = None, -1
            for i in range(len(out) - 1):
                piece = self.ids.get(out[i] + out[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if best is None:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]

    def neighbours(self, before: str, after: str) -> bool:
        """Whether BPE leaves ``before`` and ``after`` as they are where they meet (``before`` may be empty)."""
        if self.pairs >= PAIR_MEMORY:
            self.fits.clear()
            self.pairs = 0
        self.pairs += 1
        fit = self.fits.setdefault(before, {})[after] = self.merged(before + after) == ([before, after] if before else [after])
        return fit

    def _backwards(self) -> dict[str, tuple]:
        """All pieces by their characters from the last to the first: character -> (characters before it, whether a piece begins here, the piece)."""
        if not self.tree:
            grown: dict = {}
            for piece in self.ids:
                node = grown
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[""] = piece

            def packed(node: dict) -> dict[str, tuple]:
                return {c: (packed(own), "" in own, own.get("", "")) for c, own in node.items() if c}

            self.tree = packed(grown)
        return self.tree

    def search(self, text: Iterable[str]) -> Iterator[str]:
        """The pieces of a stream of characters, given out as soon as they are certain.

        Each place keeps one best way to reach it: of a unigram model, that of
        the highest sum of scores; of a BPE model, the one whose last piece is
        a neighbour that merging would leave beside the piece before (there is
        exactly one, and a way is right as a whole if all its neighbours are).
        Pieces that end at a place are found by going back through the tree of
        pieces. Only the last ``longest`` places can still be left from; where
        the ways back from all of them meet, what lies before is certain, is
        given out and forgotten.
        """
        held: list[str] = []  # characters since the last certain place, and of each place the last piece, what fits behind it, and the score
        last: list[str | None] = [""]
        rows: list[dict[str, bool]] = [self.fits.setdefault("", {})]
        sums = [0.0]
        bpe, ids, root = self.rule == BPE, self.ids, self._backwards()
        for c in text:
            held.append(c)
            kids, end = root, len(held)
            start, best, score = end, None, 0.0
            while start:
                start -= 1
                node = kids.get(held[start])
                if node is None:
                    if start < end - 1:
                        break
                    node = ({}, False, "")
                kids, whole, piece = node
                if not whole:
                    if start < end - 1:
                        continue
                    piece = c  # a character without a piece
                if last[start] is None:
                    continue
                if bpe:
                    fit = rows[start].get(piece)
                    if fit or fit is None and self.neighbours(last[start], piece):
                        best = piece
                        break
                else:
                    total = sums[start] + (self.scores[ids[piece]] if whole else self.missing)
                    if best is None or total >= score:
                        best, score = piece, total
            last.append(best)
            sums.append(score)
            rows.append(self.fits.setdefault(best, {}) if bpe and best is not None else {})
            if end >= 4 * self.longest and (at := self._meeting(last)):
                yield from self._back(last, at)
                held, last, rows, sums = held[at:], last[at:], rows[at:], sums[at:]
        yield from self._back(last, len(held))

    @staticmethod
    def _back(last: list[str | None], end: int) -> list[str]:
        out = []
        while end:
            out.append(last[end])
            end -= len(out[-1])
        return out[::-1]

    def _meeting(self, last: list[str | None]) -> int:
        """The last place that the ways back from all open places pass."""
        common: set[int] | None = None
        for end in range(len(last) - self.longest, len(last)):
            if last[end] is not None:
                way, at = {end}, end
                while at:
                    at -= len(last[at])
                    way.add(at)
                common = way if common is None else common & way
        return max(common or {0})

    def _numbers(self, pieces: Iterable[str]) -> Iterator[int]:
        for piece in pieces:
            number = self.ids.get(piece)
            if number is not None:
                yield number
            elif self.byte_fallback:
                yield from (self.bytes[b] for b in piece.encode())
            else:
                yield self.unknown

    def _packed(self, word: str, key: str) -> bytes:
        """A word's ids in 32 bits each; remembered under ``key``, unless it is long."""
        ids = list(self._numbers(self.search(word)))
        packed = struct.pack(f"<{len(ids)}i", *ids)
        if len(word) <= 40:
            if len(self.words) >= self.memory:
                self.words.clear()
            self.words[key] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """Ids as the library gives them, little-endian. No piece goes over a word's beginning, so words are searched, and remembered, by themselves."""
        if not text:
            return b""
        known = self.words
        plain = self.dummy_prefix and self.whole_words and "  " not in text and _SPACE not in text and " " not in (text[0], text[-1])
        if plain:  # each word has one blank before it, which goes without saying in the keys
            words = text.split(" ")
            return b"".join([p if (p := known.get(w)) is not None else self._packed(_SPACE + w, w) for w in words])
        text = (_SPACE if self.dummy_prefix else "") + text.replace(" ", _SPACE)
        words = _WORD.findall(text) if self.whole_words else [text]
        return b"".join([p if (p := known.get(_SPACE + w)) is not None else self._packed(w, _SPACE + w) for w in words])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; its blanks are U+0020, the one put before it is taken off again."""
        text = b"".join(map(self.plain.__getitem__, ids)).decode(errors="replace").replace(_SPACE, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


_loaded: dict[bytes, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    """A worker parses a model once, and keeps what it remembers of words."""
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded[key] = Pieces.parse(model)
    return _loaded[key]


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, model: bytes, make: Callable[[Pieces, list[str]], dict[str, pa.Array]], schema: str, words: int = MEMORY) -> DataFrame:
    if len(model) > 64 << 20:
        raise ValueError("a model file of over 64 MB is not broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        pieces.memory = words
        for batch in batches:
            _, offsets = byte_values(batch.column(1))
            for first, last in chunks(offsets, 1 << 20):
                made = make(pieces, [t or "" for t in batch.column(1).slice(first, last - first).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *made.values()], names=["doc_id", *made])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids. Null and empty texts have no ids; repeated rows are encoded each."""
    return _mapped(docs, model, lambda p, texts: {"ids": pa.array([p.encode(t) for t in texts], pa.list_(pa.int32()))}, "ids array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text of rows with ids; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for batch in batches:
            texts = [pieces.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: bytes, *, words: int = MEMORY, with_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 (of the decoded text), exact; and ids, if wanted.

    ``exact`` is false only for texts with U+2581, which stands for a blank
    (and for such as a model without byte fallback has no pieces for).

    Defined cases: null and empty texts have no ids; a text of any length is
    searched as a stream; repeated rows are answered each; a null id stays;
    columns but doc_id and text are not read.
    """

    def made(pieces: Pieces, texts: list[str]) -> dict[str, pa.Array]:
        rows, every = [], []
        for text in texts:
            packed = pieces.encode_packed(text)
            ids = np.frombuffer(packed, "<i4").tolist()
            back = pieces.decode(ids)
            rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
            if with_ids:
                every.append(packed)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
        found = {n: pa.array(c, k) for n, c, k in zip(("n_ids", "ids_sha256", "decoded_sha256", "exact"), zip(*rows), kinds, strict=True)}
        if with_ids:
            ends = np.concatenate([[0], np.cumsum([r[0] for r in rows])]).astype(np.int32)
            found["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(every), "<i4")))
        return found

    return _mapped(docs, model, made, "n_ids long, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<int>" * with_ids, words)
