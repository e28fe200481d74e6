"""Benchmark decontamination by suffix arrays over the training shards."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, byte_values, chunks

#: Words in a window.
WINDOW = 10
#: Benchmark text handled in one pass over the training data: what a block's index on the driver and in tasks is bound by.
BLOCK_BYTES = 8 << 20

_LOWER = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)
_BITS = 21
#: Words of one suffix array; longer documents are cut, overlapping by the longest test suffix.
SHARD_WORDS = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased A-Z; runs of digits, letters a-z and bytes over 0x7F."""
    return text.translate(_LOWER).split()


@dataclass
class Tests:
    """One block of items: their words once, and the places in them where test suffixes begin."""

    vocabulary: dict[bytes, int]
    words: np.ndarray  # word numbers of all items, one behind the other, a 0 after each
    starts: np.ndarray  # where the suffixes begin, by the words of their windows
    first: np.ndarray  # where each distinct window's suffixes begin in ``starts``, and the end
    window: np.ndarray  # words of each distinct window: all of a short item, else the same number
    holders: np.ndarray  # items that hold each window, without repeats
    held: np.ndarray  # where each window's items begin in ``holders``, and the end
    names: list[str]
    longest: int

    def heads(self) -> np.ndarray:
        """The words of each distinct window, a row each, zeros behind the end."""
        width = np.arange(int(self.window.max()))
        own = self.starts[self.first[:-1]][:, None] + width
        return np.where(width < self.window[:, None], self.words[np.minimum(own, len(self.words) - 1)], 0)


def _sorted_rows(rows: np.ndarray) -> np.ndarray:
    """The order of rows of word numbers, three numbers a key."""
    wide = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 3))).astype(np.int64)
    keys = (wide[:, 0::3] << (2 * _BITS)) | (wide[:, 1::3] << _BITS) | wide[:, 2::3]
    return np.lexsort(keys.T[::-1])


def test_suffixes(items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> Tests | None:
    """Room and time grow with the items' words alone: a suffix is a place, not a copy."""
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    parts, starts, sizes, owners, end = [], [], [], [], 0
    for name, text in items:
        own = words_of(text)
        if not own:
            continue
        ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in own), np.int32, len(own))
        parts += [ids, np.zeros(1, np.int32)]
        begins = np.arange(end, end + max(1, len(ids) - window + 1))
        starts.append(begins)
        sizes.append(np.full(len(begins), min(len(ids), window)))
        owners.append(np.full(len(begins), names.setdefault(name, len(names)), np.int32))
        end += len(ids) + 1
    if not parts:
        return None
    if len(vocabulary) >= 1 << _BITS:
        raise ValueError("a block of items holds more distinct words than a key has room for; lower BLOCK_BYTES")
    words, begin, size, owner = (np.concatenate(x) for x in (parts, starts, sizes, owners))
    within = np.arange(int(size.max()))
    rows = np.where(within < size[:, None], words[np.minimum(begin[:, None] + within, len(words) - 1)], 0)
    order = _sorted_rows(rows)
    rows = rows[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(1)))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
    pairs = np.unique(group * np.int64(len(names)) + owner[order])
    held = np.searchsorted(pairs, np.arange(len(first) + 1) * np.int64(len(names)))
    longest = max(len(x) for x in parts)
    return Tests(vocabulary, words, begin[order], np.append(first, len(rows)), size[order][first], (pairs % len(names)).astype(np.int32), held, list(names), longest)


def suffix_array(words: np.ndarray, least: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions in suffix order, and those starts' words (a row each, zeros behind the first zero).

    ``words`` are numbers, 0 where a document ends or a word stands that no
    item has. A suffix that meets a zero within ``least`` words can match no
    window and is left out; the others are sorted by ``depth`` words, a window's.
    """
    zeros = np.flatnonzero(words == 0)
    ends = np.append(zeros, len(words))
    run = ends[np.searchsorted(ends, np.arange(len(words)))] - np.arange(len(words))
    starts = np.flatnonzero(run >= least)
    if not len(starts):
        return starts, np.zeros((0, depth), np.int32)
    padded = np.concatenate([words, np.zeros(depth, words.dtype)])
    rows = padded[starts[:, None] + np.arange(depth)]
    rows[np.arange(depth) >= run[starts, None]] = 0
    order = _sorted_rows(rows)
    return starts[order], rows[order]


def _as_text(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">i4")).view(f"S{4 * rows.shape[1]}").ravel()


def bounds(rows: np.ndarray, heads: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range of the suffix array that begins with its ``lengths`` words, by binary search."""
    texts = _as_text(rows)
    beyond = np.where(np.arange(heads.shape[1]) < lengths[:, None], heads, np.iinfo(np.int32).max)
    return np.searchsorted(texts, _as_text(heads), "left"), np.searchsorted(texts, _as_text(beyond), "right")


def _runs(size: int, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places below ``size`` that a window covers."""
    cover = np.zeros(size + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + lengths, size), -1)
    return np.flatnonzero(np.cumsum(cover[:-1]) > 0)


def longest_matches(words: np.ndarray, at: np.ndarray, lengths: np.ndarray, tests: Tests, tails: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each of the places ``at`` the most words that any test suffix in ``tails`` shares with the text from there on.

    No match reaches beyond the words that windows cover, here and in the
    items; so these alone are put in suffix order, by doubling, and a place's
    best partner is the nearest test suffix before or behind it. Each run ends
    in a number of its own, which no match goes over.
    """
    runs = (_runs(len(words), at, lengths), _runs(len(tests.words), tails, sizes))
    values, places, top, base = [], [], len(tests.vocabulary) + 1, 0
    for own, numbers in zip(runs, (words, tests.words), strict=True):
        run = np.cumsum(np.append(0, np.diff(own) > 1))
        joint = np.full(len(own) + run[-1] + 1, -1, np.int64)
        place = np.arange(len(own)) + run
        joint[place] = numbers[own]
        gaps = np.flatnonzero(joint < 0)
        joint[gaps] = top + np.arange(len(gaps))
        top += len(gaps)
        values.append(joint)
        places.append((own, place + base))
        base += len(joint)
    joint = np.concatenate(values)
    here, there = (own_at[np.searchsorted(own, x)] for (own, own_at), x in zip(places, (at, tails), strict=True))
    ranks, step = [np.unique(joint, return_inverse=True)[1]], 1
    while ranks[-1].max() + 1 < len(joint):
        ahead = np.append(ranks[-1][step:], np.zeros(min(step, len(joint)), np.int64)) if step < len(joint) else np.zeros(len(joint), np.int64)
        ranks.append(np.unique(ranks[-1] * np.int64(len(joint)) + ahead, return_inverse=True)[1])
        step *= 2
    there = np.unique(there)
    order = ranks[-1]
    by_rank = there[np.argsort(order[there])]
    behind = np.searchsorted(order[by_rank], order[here])
    best = np.zeros(len(here), np.int64)
    for partner in (behind - 1, behind):
        a, b = here.copy(), by_rank[np.clip(partner, 0, len(by_rank) - 1)].copy()
        inside = (partner >= 0) & (partner < len(by_rank))
        shared = np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            alike = ranks[k][np.minimum(a, len(joint) - 1)] == ranks[k][np.minimum(b, len(joint) - 1)]
            shared += alike.astype(np.int64) << k
            a, b = a + (alike.astype(np.int64) << k), b + (alike.astype(np.int64) << k)
        best = np.maximum(best, np.where(inside, shared, 0))
    return best


def _matches(words: np.ndarray, tests: Tests, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    starts, rows = suffix_array(words, int(tests.window.min()), heads.shape[1])
    if not len(starts):
        return none, none, none
    seen = np.zeros(len(tests.vocabulary) + 1, bool)
    seen[words] = True
    seen[0] = True
    able = np.arange(len(heads))
    for i in range(heads.shape[1]):  # a window with a word that the shard has not is in no suffix of it
        able = able[seen[heads[able, i]]]
    low, high = bounds(rows, heads[able], tests.window[able])
    sizes = high - low
    found = able[sizes > 0]
    if not len(found):
        return none, none, none
    which = np.repeat(able, sizes)
    at = starts[np.repeat(low, sizes) + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    count = tests.first[found + 1] - tests.first[found]
    tail = np.repeat(tests.first[found], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    length = longest_matches(words, at, tests.window[which], tests, tests.starts[tail], np.repeat(tests.window[found], count))
    return at, which, length


def matches(words: np.ndarray, tests: Tests, heads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence of every window: start position, window, and words of the longest verbatim match of any test suffix there."""
    heads = tests.heads() if heads is None else heads
    parts = []
    for first in range(0, max(1, len(words)), SHARD_WORDS):
        at, which, length = _matches(words[first : first + SHARD_WORDS + tests.longest], tests, heads)
        mine = at < SHARD_WORDS
        parts.append((at[mine] + first, which[mine], length[mine]))
    at, which, length = (np.concatenate(x) for x in zip(*parts))
    return at, which, length


def numbered(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The vocabulary's numbers of a text's words, 0 for others; cut between words, so that long texts need little room."""
    clean, out, first = text.translate(_LOWER), [], 0
    while first < len(clean):
        last = clean.find(b" ", first + CHUNK_BYTES)
        last = last if last >= 0 else len(clean)
        words = clean[first:last].split()
        out.append(np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words)))
        first = last
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _shard(texts: list[bytes], tests: Tests, heads: np.ndarray) -> list[tuple]:
    """Results of one shard's documents: n_words, n_hit, spans, items, longest match."""
    tokens = [numbered(t, tests.vocabulary) for t in texts]
    lengths = np.array([len(t) for t in tokens], np.int64)
    words = np.concatenate([x for t in tokens for x in (t, np.zeros(1, np.int32))])
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    at, which, longest = matches(words, tests, heads)
    hit = np.zeros(len(words), np.int8)
    hit[_runs(len(words), at, tests.window[which])] = 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
    spans, doc_of_span = edges.reshape(-1, 2), np.searchsorted(begins, edges[::2], "right") - 1
    doc_of_match = np.searchsorted(begins, at, "right") - 1
    out: list[tuple] = [(int(n), 0, [], [], 0) for n in lengths]
    order = np.argsort(doc_of_match, kind="stable")
    hit_docs, firsts = np.unique(doc_of_match[order], return_index=True)
    for d, mine in zip(hit_docs, np.split(order, firsts[1:]), strict=True) if len(hit_docs) else ():
        held = np.unique(np.concatenate([tests.holders[tests.held[w] : tests.held[w + 1]] for w in np.unique(which[mine])]))
        own = spans[slice(*np.searchsorted(doc_of_span, [d, d + 1]))]
        ranges = [{"start": int(a - begins[d]), "words": int(b - a)} for a, b in own]
        out[d] = (int(lengths[d]), sum(r["words"] for r in ranges), ranges, sorted(tests.names[i] for i in held), int(longest[mine].max()))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))


def _pass(docs: DataFrame, tests: Tests | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tests)
    schema = "doc_id long, doc_key long, n_words long, n_hit long, spans array<struct<start:long,words:long>>, items array<string>, longest_match long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        heads = found.heads() if found else None
        for batch in batches:
            data, offsets = byte_values(batch.column(2))
            for first, last in chunks(offsets):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)]
                rows = _shard(texts, found, heads) if found else [(len(words_of(t)), 0, [], [], 0) for t in texts]
                n_words, n_hit, spans, items, longest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                        pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, _SPANS),
                        pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64()),
                    ],
                    names=["doc_id", "doc_key", "n_words", "n_hit", "spans", "items", "longest_match"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc_key"), F.col("text").cast("binary").alias("text")
    )
    return rows.mapInArrow(run, schema)


def _joined(parts: list[DataFrame]) -> DataFrame:
    """Results of several blocks of items, brought together by document; rows that repeat one are counted, and given back as often."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    whole = both.groupBy("doc_id", "doc_key").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("found"), F.max("longest_match").alias("longest_match"),
        (F.count(F.lit(1)) / len(parts)).cast("int").alias("rows"),
    ).withColumn("row", F.explode(F.array_repeat(F.lit(0), F.col("rows"))))
    start = F.array().cast("array<struct<start:bigint,words:bigint>>")

    def add(done, x):
        last = F.element_at(done, -1)
        end = last["start"] + last["words"]
        wider = F.struct(last["start"].alias("start"), (F.greatest(end, x["start"] + x["words"]) - last["start"]).alias("words"))
        return F.when((F.size(done) > 0) & (x["start"] <= F.when(F.size(done) > 0, end)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    spans = F.aggregate("found", start, add)
    return whole.withColumn("spans", spans).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["words"])).select(
        "doc_id", "doc_key", "n_words", "n_hit", "spans", "items", "longest_match"
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans, items, longest_match, contaminated.

    A task makes the suffix array of each shard it reads (``CHUNK_BYTES`` of
    text, or one longer document), in words, and binary-searches the window
    that each test suffix begins with; from where they stand, all suffixes of
    that window are followed to the longest match. ``spans`` are the hit word
    ranges, ``longest_match`` the most words that a test suffix shares with the
    document from some place on. Items go in blocks of ``block_bytes`` or so,
    one pass over the documents each, so that neither driver nor tasks ever
    hold more of the benchmark than a block or, if that is longer, one item.

    Defined cases: null texts have no words; items without words are never
    found; a null item_id is named as an empty string; items that repeat an id
    count once; rows that repeat a document are answered each alike, whatever
    the number of blocks; columns but doc_id and text are not read.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    parts = []
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        parts.append(_pass(docs, test_suffixes(((r.item_id, bytes(r.text)) for r in block.toLocalIterator()), window)))
    whole = parts[0] if blocks == 1 else _joined(parts)
    return whole.withColumn("contaminated", F.col("n_hit") > 0)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest_match",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, that hold no window of any item of at least ``window`` words.

    Shorter items are too common to tell a leak from chance and remove nothing.
    Rows go by the content of their text, so that null or repeated ids are safe.
    """
    long_enough = benchmark.where(F.size(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " ")) >= window)
    bad = find_contamination(docs, long_enough, window=window).where("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("doc_key").alias("__bad_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (F.xxhash64("doc_id", "text") == F.col("__bad_key"))
    return docs.join(bad, same, "left_anti")


_A_TO_Z = "".join(map(chr, range(65, 91)))
ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A_TO_Z}', '{_A_TO_Z.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_A_TO_Z}', '{_A_TO_Z.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
tests AS (SELECT item, k, t, array_to_string(w[t : t + k - 1], ' ') AS key FROM (
  SELECT item, w, least(len(w), {WINDOW}) AS k, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS t FROM items WHERE len(w) > 0)),
places AS (SELECT row, k, p, array_to_string(w[p : p + k - 1], ' ') AS key FROM (
  SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs, (SELECT DISTINCT k FROM tests) WHERE len(w) >= k)),
hits AS (SELECT DISTINCT row, k, p, item, t FROM places JOIN tests USING (k, key)),
hit AS (SELECT row, count(DISTINCT p + i) AS n_hit FROM (SELECT DISTINCT row, k, p FROM hits), range({WINDOW}) r(i) WHERE i < k GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row),
runs AS (SELECT row, max(n) AS longest_match FROM (SELECT row, count(*) + k - 1 AS n FROM (
  SELECT *, p - row_number() OVER (PARTITION BY row, k, item, p - t ORDER BY p) AS run FROM hits) GROUP BY row, k, item, p - t, run) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_match, 0)::BIGINT AS longest_match
FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row) LEFT JOIN runs USING (row)
"""
