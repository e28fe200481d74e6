"""Removal of long repeated byte strings by an enhanced suffix array over content-defined anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, chunks, document_key, mix64, shared_dir, written

#: Bytes of a string that is removed where it repeats.
LENGTH = 200
#: Bytes of an anchor.
GRAM = 50
#: Occurrences of an anchor that one task sorts; those of commoner anchors go by windows, grouped by hash and bytes.
CELL = 1 << 16
#: Bytes of a document that are hashed at a time.
SEGMENT = 1 << 20
#: Stands for a null id.
NO_ID = -(2**63)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
_MOST = np.uint64(2**64 - 1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    name = str(base)
    if len(_powers.get(name, ())) < n:
        _powers[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(base))]))
    return _powers[name][:n]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(_BASE, len(data)))])
    return mix64((sums[size:] - sums[:-size]) * _power(_INVERSE, n))


def _sliding(x: np.ndarray, width: int, best: np.ufunc, neutral: int) -> np.ndarray:
    """best(x[i : i + width]) for each i with a whole window."""
    n = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, neutral, x.dtype)]).reshape(-1, width)
    ahead = best.accumulate(blocks, 1).ravel()
    back = best.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return best(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the least grams of every window of ``length`` bytes that lies within one document.

    ``starts`` are the documents' offsets (one more than documents). What is
    chosen depends on the window's bytes alone, so equal windows have equal
    anchors at equal distances.
    """
    width = length - gram + 1
    hashes = gram_hashes(data, gram)
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, ends = starts[:-1], starts[1:]
    inside = np.zeros(len(hashes) + 1, np.int32)
    fits = ends - starts >= length
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - length + 1, -1)
    least = np.where(np.cumsum(inside)[: len(hashes) - width + 1] > 0, _sliding(hashes, width, np.minimum, int(_MOST)), 0)
    zeros = np.zeros(width - 1, np.uint64)
    top = _sliding(np.concatenate([zeros, least, zeros]), width, np.maximum, 0)
    at = np.flatnonzero((top == hashes) & (top > 0))
    return at, hashes[at]


def periodic(data: np.ndarray, ends: np.ndarray, at: np.ndarray, hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which anchors to keep, and byte ranges that repeat themselves a period on.

    Text of a period shorter than a window has an anchor each period. Every
    window of such a range also starts a period before or behind, if the range
    is longer than window and period together; so the range is covered as it
    stands. Of its anchors those near its ends are kept: they stand for the
    windows that leave the range, and for each rotation of the period.
    """
    keep, ranges = np.ones(len(at), bool), []
    gap = np.diff(at)
    end_of = ends[np.searchsorted(ends, at, "right")]
    alike = (hashes[1:] == hashes[:-1]) & (end_of[1:] == end_of[:-1])
    chained = alike[1:] & alike[:-1] & (gap[1:] == gap[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], chained.astype(np.int8), [0]])))
    for first, last in zip(edges[::2], edges[1::2] + 1, strict=True):
        period, low, high = int(gap[first]), int(at[first]), int(at[last])
        if high + gram - low < length + period:
            continue
        same = data[low : high + gram - period] == data[low + period : high + gram]
        if not same.all():
            continue
        ranges.append((low, high + gram))
        keep[first : last + 1][(at[first : last + 1] >= low + length - gram + period) & (at[first : last + 1] <= high + gram - length)] = False
    return keep, ranges


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, doc_id, doc_key, at; and the ranges that repeat themselves, as rows with ``stop``."""

    def of_long(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found: dict[int, int] = {}
        for first in range(0, len(own) - length + 1, SEGMENT - length + 1):
            part = own[first : first + SEGMENT]
            at, hashes = anchors(part, np.array([0, len(part)]), length, gram)
            found.update(zip((at + first).tolist(), hashes.tolist(), strict=True))
        at = np.array(sorted(found), np.int64)
        return at, np.array([found[x] for x in at.tolist()], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_values(batch.column(2))
            for first, last in chunks(offsets, SEGMENT):
                own, begins = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                at, hashes = of_long(own) if len(own) > SEGMENT and last - first == 1 else anchors(own, begins, length, gram)
                keep, ranges = periodic(own, begins[1:], at, hashes, length, gram)
                spans = np.array(ranges, np.int64).reshape(-1, 2)
                at = np.concatenate([at[keep], spans[:, 0]])
                hashes = np.concatenate([hashes[keep], mix64(spans[:, 0].astype(np.uint64))])
                stop = np.concatenate([np.full(keep.sum(), -1, np.int64), spans[:, 1]])
                doc = np.searchsorted(begins, at, "right") - 1
                stop = np.where(stop < 0, -1, stop - begins[doc])
                rows = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - begins[doc]), pa.array(stop, mask=stop < 0)],
                    names=["anchor", "doc_id", "doc_key", "at", "stop"],
                )

    return docs.mapInArrow(run, "anchor long, doc_id long, doc_key long, at long, stop long")


def _contexts(placed: DataFrame, length: int, gram: int) -> DataFrame:
    """Of each repeated anchor the bytes around it; the left ones reversed, unless it is hot."""
    before = length - gram
    schema = "anchor long, hot boolean, doc_id long, doc_key long, at long, stop long, left binary, right binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_values(batch.column(2))
            lists = batch.column(3)
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(ends[0], ends[-1] - ends[0])
            fields = {x: flat.field(x).to_numpy(zero_copy_only=False) for x in ("at", "anchor", "hot")}
            stops = flat.field("stop")
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            place = fields["at"] + offsets[row]
            for first in range(0, len(row), 20_000):
                part = slice(first, first + 20_000)
                r, p = row[part], place[part]
                low, high = np.maximum(p - before, offsets[r]), np.minimum(p + length, offsets[r + 1])
                left = [(data[a:b] if hot else data[a:b][::-1]).tobytes() for a, b, hot in zip(low, p, fields["hot"][part], strict=True)]
                right = [data[a:b].tobytes() for a, b in zip(p, high, strict=True)]
                rows = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fields["anchor"][part]), pa.array(fields["hot"][part]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(fields["at"][part]), stops.slice(first, len(r)), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    names=["anchor", "hot", "doc_id", "doc_key", "at", "stop", "left", "right"],
                )

    return placed.select("doc_id", "doc_key", "text", "places").mapInArrow(run, schema)


def _padded(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(-1, width), sizes


def _common(rows: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that rows a and rows b begin with alike."""
    differs = rows[a] != rows[b]
    first = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[a], sizes[b]))


def _sorted(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    return order[np.argsort(group[order], kind="stable")]


def common_prefix_intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Depth, first and last suffix of each interval of a suffix array, children before parents; lcp[i] is of suffixes i - 1 and i.

    One scan with a stack of open intervals; a negative lcp parts groups.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp[1:].tolist(), -1], 1):
        begin = i - 1
        while stack and stack[-1][0] > depth:
            top, begin = stack.pop()
            yield top, begin, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))


def extended_intervals(group: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Intervals of the suffixes that begin at anchors, if some of their members share ``length`` bytes or more with the bytes before.

    Gives the bytes that all members share from the anchor on, the members
    sorted by what stands before them, how many bytes there each shares with
    the next, and the child interval that each is of.
    """
    right, right_size = _padded(rights, length)
    left, left_size = _padded(lefts, length - gram)
    order = _sorted(group, right)
    rank = np.empty(len(group), np.int64)
    rank[_sorted(group, left)] = np.arange(len(group))
    lcp = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        lcp[1:] = np.where(group[order[1:]] == group[order[:-1]], _common(right, right_size, order[:-1], order[1:]), -1)
    for depth, first, last in common_prefix_intervals(lcp):
        members = order[first : last + 1]
        by_left = np.argsort(rank[members])
        members = members[by_left]
        shared = _common(left, left_size, members[:-1], members[1:])
        if shared.max() + depth >= length:
            yield depth, members, shared, np.concatenate([[0], np.cumsum(lcp[first + 1 : last + 1] == depth)])[by_left]


def maximal_repeats(group: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats of ``length`` bytes or more around anchors: bytes from the anchor on, bytes before it, and all members.

    The members of an interval, sorted by the bytes before their anchors, have
    intervals of common extensions to the left in turn; such a one is
    left-diverse, as two of its members differ in the byte before, or one has
    none. It is a repeat of its own if it is right-diverse as well, that is, if
    its members are not all within one child of the first interval; else that
    child gives it, and longer.
    """
    for depth, members, shared, child in extended_intervals(group, lefts, rights, length, gram):
        long = np.concatenate([[False], shared + depth >= length, [False]])
        edges = np.flatnonzero(long[1:] != long[:-1])
        for a, b in zip(edges[::2], edges[1::2] + 1, strict=True):
            for extension, low, high in common_prefix_intervals(np.concatenate([[-1], shared[a : b - 1]])):
                own = slice(a + low, a + high + 1)
                if (child[own] != child[a + low]).any():
                    yield depth, extension, members[own]


def reach(group: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and from each anchor on that its maximal repeats cover together, 0 if there are none.

    A member's longest extension in an interval is that of the innermost
    left-diverse interval that holds it, which is a maximal repeat there or,
    longer, in a child; all hold the anchor, so together they are one range.
    The repeats themselves need not be listed for it.
    """
    low, high = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    edge = np.zeros(1, np.int64)
    for depth, members, shared, _ in extended_intervals(group, lefts, rights, length, gram):
        extension = np.maximum(np.concatenate([edge, shared]), np.concatenate([shared, edge]))
        enough = extension + depth >= length
        own, extension = members[enough], extension[enough]
        low[own] = np.maximum(low[own], extension)
        high[own] = np.maximum(high[own], depth)
    return low, high


def _whole_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by anchor, some thousand at a time, cut between anchors."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < 8000:
            continue
        whole = pa.Table.from_batches(held)
        anchor = whole["anchor"].to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
        if cut:
            yield whole.slice(0, cut)
            held, size = whole.slice(cut).to_batches(), len(whole) - cut
    if held:
        yield pa.Table.from_batches(held)


def _contexts_of(rows: pa.Table) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    return rows["anchor"].to_numpy(), rows["left"].to_pylist(), rows["right"].to_pylist()


def _covered(cells: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, doc_key, start, stop: what the maximal repeats around each anchor cover, and the ranges that repeat themselves. Rows come sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_anchors(batches):
            own = rows["stop"].is_valid().to_numpy()
            if own.any():
                yield from rows.filter(pa.array(own)).select(["doc_id", "doc_key", "at", "stop"]).rename_columns(["doc_id", "doc_key", "start", "stop"]).to_batches()
                rows = rows.filter(pa.array(~own))
            low, high = reach(*_contexts_of(rows), length, gram)
            if len(hit := np.flatnonzero(high)):
                at = rows["at"].to_numpy()[hit]
                rows = rows.select(["doc_id", "doc_key"]).take(pa.array(hit)).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"].combine_chunks(), rows["doc_key"].combine_chunks(), pa.array(at - low[hit]), pa.array(at + high[hit])],
                    names=["doc_id", "doc_key", "start", "stop"],
                )

    return cells.select("anchor", "doc_id", "doc_key", "at", "stop", "left", "right").mapInArrow(run, "doc_id long, doc_key long, start long, stop long")


def _grouped(cells: DataFrame, length: int, gram: int) -> DataFrame:
    """repeat, length, cut, doc_id, doc_key, start: a row for each occurrence of each maximal repeat."""
    schema = "repeat string, length long, cut boolean, doc_id long, doc_key long, start long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_anchors(batches):
            rows = rows.filter(rows["stop"].is_null()).combine_chunks()
            at, left, right = rows["at"].to_numpy(), rows["left"], rows["right"]
            for depth, extension, members in maximal_repeats(*_contexts_of(rows), length, gram):
                one = int(members[0])
                text = left[one].as_py()[:extension][::-1] + right[one].as_py()[:depth]
                own = rows.select(["doc_id", "doc_key"]).take(pa.array(members)).combine_chunks()
                n, cut = len(members), extension == length - gram or depth == length
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(text, digest_size=16).hexdigest()] * n), pa.array([len(text)] * n, pa.int64()), pa.array([cut] * n),
                     own["doc_id"].combine_chunks(), own["doc_key"].combine_chunks(), pa.array(at[members] - extension)],
                    names=["repeat", "length", "cut", "doc_id", "doc_key", "start"],
                )

    return cells.select("anchor", "doc_id", "doc_key", "at", "stop", "left", "right").mapInArrow(run, schema)


def _windows(hot: DataFrame, length: int) -> DataFrame:
    """Each whole window around each hot anchor: doc_id, doc_key, start, its bytes, and a 128-bit hash of them."""
    rows = hot.select("doc_id", "doc_key", (F.col("at") - F.length("left")).alias("begin"), F.concat("left", "right").alias("bytes"), F.length("left").alias("ahead"))
    last = F.least(F.col("ahead"), F.length("bytes") - length)
    rows = rows.where(F.length("bytes") >= length).select("doc_id", "doc_key", "begin", "bytes", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    window = F.substring(F.col("bytes"), F.col("i") + 1, F.lit(length))
    return rows.select("doc_id", "doc_key", (F.col("begin") + F.col("i")).alias("start"), window.alias("window"), F.xxhash64(window).alias("h1"), F.xxhash64(F.lit("second half"), window).alias("h2"))


def _repeated_windows(hot: DataFrame, length: int) -> DataFrame:
    """doc_id, doc_key, start, h3 of windows that stand in two places or more: grouped by hash and bytes, partial before the shuffle."""
    windows, place = _windows(hot.dropDuplicates(["doc_id", "doc_key", "at"]), length), ("doc_id", "doc_key", "start")
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in place for f in (F.min, F.max)]
    elsewhere = F.array_contains(F.array(*[F.col(f"{c}_min") != F.col(f"{c}_max") for c in place]), True)
    twice = windows.groupBy("h1", "h2", "window").agg(*ends).where(elsewhere)
    light = windows.select("doc_id", "doc_key", "start", "h1", "h2", F.md5("window").alias("h3"))
    return light.join(twice.select("h1", "h2", F.md5("window").alias("h3")), ["h1", "h2", "h3"])


def _around(docs: DataFrame, found: DataFrame, kind: DataFrame, hot: bool, length: int, gram: int) -> DataFrame:
    """The bytes around the anchors of a kind. A place counts once, however many rows repeat a document, so each of these rows is read with its own places only."""
    chosen = found.join(kind, "anchor", "left").where(F.col("n").isNotNull() & F.col("stop").isNull() | F.lit(not hot) & F.col("stop").isNotNull())
    places = chosen.groupBy("doc_id", "doc_key").agg(F.collect_set(F.struct("at", "anchor", F.lit(hot).alias("hot"), "stop")).alias("places"))
    return _contexts(docs.join(places, ["doc_id", "doc_key"]), length, gram)


def _kinds(docs: DataFrame, length: int, gram: int, cell: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Anchors; the contexts of those of up to ``cell`` occurrences, dealt out and sorted by anchor; and of commoner ones, if there are."""
    where = shared_dir(docs.sparkSession)
    found = _anchors(docs, length, gram)
    often = written(found.where(F.col("stop").isNull()).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), where)
    cells = _around(docs, found, often.where(F.col("n") <= cell), False, length, gram).repartition("anchor").sortWithinPartitions("anchor")
    common = often.where(F.col("n") > cell)
    hot = written(_around(docs, found, common, True, length, gram), f"{where}-hot") if common.limit(1).count() else None
    return found, cells, hot


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """doc_id, doc_key, start, stop of byte ranges that repeated strings of ``length`` bytes cover.

    By the maximal repeats of suffix arrays; and by windows, compared by their
    bytes, for anchors of over ``cell`` occurrences. There, rows that repeat a
    document are not two places, and such a document is covered whole.
    """
    _, cells, hot = _kinds(docs, length, gram, cell)
    spans = _covered(cells, length, gram)
    if hot is not None:
        windows = _repeated_windows(hot, length)
        again = docs.groupBy("doc_id", "doc_key").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).cast("long").alias("stop")).where((F.col("n") > 1) & (F.col("stop") >= length))
        spans = spans.unionByName(windows.select("doc_id", "doc_key", "start", (F.col("start") + length).alias("stop")))
        spans = spans.unionByName(again.select("doc_id", "doc_key", F.lit(0).cast("long").alias("start"), "stop"))
    return spans


def repeat_groups(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """Maximal repeats with all their occurrences, one a row: repeat (hash of its bytes), length, cut, doc_id, doc_key, start.

    A repeat is found around each anchor in it, ``length`` bytes from the anchor
    on and ``length - gram`` before it; ``cut`` tells that it reaches an end of
    what was seen there and may go on in both, its next anchor giving the next
    part. Of anchors with over ``cell`` occurrences windows of ``length`` bytes
    come, cut. Text that repeats itself a period on is no group; see ``spans``
    of :func:`remove_repeats`. A group's rows are never gathered.
    """
    rows = _rows(docs)
    _, cells, hot = _kinds(rows, length, gram, cell)
    groups = _grouped(cells, length, gram)
    if hot is not None:
        groups = groups.unionByName(_repeated_windows(hot, length).select(F.col("h3").alias("repeat"), F.lit(length).cast("long").alias("length"), F.lit(True).alias("cut"), "doc_id", "doc_key", "start"))
    return groups.distinct().withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id (NO_ID for null, which joins; the key tells the two apart), doc_key, text as bytes."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), document_key().alias("doc_key"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, spans, kept (the remaining bytes).

    Every window of ``length`` bytes holds an anchor, a least gram; only
    anchors that occur twice are looked at again, with the bytes around them.
    Periodic text, which would have an anchor each period, is settled where it
    stands.
    An anchor's occurrences meet in one task up to ``cell`` of them; of
    commoner ones every window is grouped by its hash and bytes, which is
    partial before the shuffle and never gathers a group.

    Defined cases: a null text is empty; strings never cross documents; a row
    that repeats another's text, with its id or another, repeats every string
    in it; documents under ``length`` bytes stay whole; bytes need not be UTF-8
    after removal; columns but doc_id and text are not read.
    """
    rows = _rows(docs)
    spans = repeated_spans(rows, length=length, gram=gram, cell=cell).groupBy("doc_id", "doc_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    both = rows.join(spans, ["doc_id", "doc_key"], "left").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_values(batch.column(1))
            lists = batch.column(2)
            for first in range(0, len(batch), 500):
                out: list[tuple] = []
                for i in range(first, min(first + 500, len(batch))):
                    own, merged = data[offsets[i] : offsets[i + 1]], []
                    if lists[i].is_valid:
                        values = lists[i].values
                        starts, stops = values.field("start").to_numpy(), values.field("stop").to_numpy()
                        by = np.argsort(starts, kind="stable")
                        starts, reach = starts[by], np.maximum.accumulate(stops[by])
                        new = np.concatenate([[True], starts[1:] > reach[:-1]])
                        ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
                        merged = list(zip(starts[new].tolist(), ends.tolist(), strict=True))
                    pieces, at = [], 0
                    for a, b in merged:
                        pieces.append(own[at:a].tobytes())
                        at = b
                    pieces.append(own[at:].tobytes())
                    out.append((len(own), sum(b - a for a, b in merged), len(merged), [{"start": a, "stop": b} for a, b in merged], b"".join(pieces)))
                n_bytes, n_removed, n_spans, spans, kept = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(out)), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
                )

    return both.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """What the operator must give, by counting every string; for small inputs."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT row, doc_id, h, length(h) // 2 AS n FROM docs),
parts AS (SELECT row, c * 1000 AS base, h[c * 2000 + 1 : c * 2000 + {2 * (999 + LENGTH)}] AS piece FROM (SELECT row, h, unnest(range(0, (n + 999) // 1000)) AS c FROM sized)),
windows AS (SELECT row, base + i AS p, md5(piece[2 * i + 1 : 2 * (i + {LENGTH})]) AS m FROM (SELECT row, base, piece, unnest(range(0, least(1000, length(piece) // 2 - {LENGTH - 1}))) AS i FROM parts WHERE length(piece) >= {2 * LENGTH})),
twice AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
gone AS (SELECT row, p FROM windows SEMI JOIN twice USING (m)),
marked AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY row ORDER BY p) > {LENGTH}, true) AS fresh FROM gone),
spans AS (SELECT row, nth, min(p) AS a, max(p) + {LENGTH} AS b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY row ORDER BY p) AS nth FROM marked) GROUP BY row, nth),
kept AS (SELECT row, a, h[2 * coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) + 1 : 2 * a] AS piece FROM spans JOIN sized USING (row)
  UNION ALL SELECT row, n + 1, h[2 * coalesce(max(b), 0) + 1 :] FROM sized LEFT JOIN spans USING (row) GROUP BY row, n, h),
texts AS (SELECT row, string_agg(piece, '' ORDER BY a) AS k FROM kept GROUP BY row),
sums AS (SELECT row, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY row)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM sized JOIN texts USING (row) LEFT JOIN sums USING (row)
"""
