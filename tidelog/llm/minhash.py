"""Near-duplicates by circulant MinHash, banding, and exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, chunks, mix64, scratch, shared_dir, written
from .graph import components

SHINGLE = 5
#: Bands and rows: two sets of Jaccard similarity 0.85 share no band with probability below 1e-6, of 0.8 below 1e-4.
BANDS, ROWS = 24, 5
#: Shingles of all members that one task links at a time.
CELL_SHINGLES = 4_000_000
_STRIDE = np.uint32(0x3C6EF372)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space (0x09 to 0x0D and 0x20)."""
    return text.lower().split()


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; a shorter text is one shingle, one without words none."""
    words = [words_of(t) for t in texts]
    flat = [w for own in words for w in own]
    if not flat:
        return [np.zeros(0, np.uint64) for _ in texts]
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for j in range(size):
        rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(rolled)])
    out, first = [], 0
    for own in words:
        n = len(own)
        if n >= size:
            out.append(np.unique(rolled[first : first + n - size + 1]))
        elif n:
            short = np.uint64(n)
            for h in hashes[first : first + n]:
                short = mix64(np.array([short ^ h]))[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        first += n
    return out


def _permuted(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit integers: shifts and odd factors."""
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=out)
    np.multiply(out, np.uint32(0x7FEB352D), out=out)
    np.right_shift(out, np.uint32(15), out=spare)
    np.bitwise_xor(out, spare, out=out)
    np.multiply(out, np.uint32(0x846CA68B), out=out)
    np.right_shift(out, np.uint32(16), out=spare)
    np.bitwise_xor(out, spare, out=out)
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of sets that are not empty: sets x coordinates.

    The first permutation places each element on the circle of 32-bit
    integers; coordinate k is the least value that the second permutation,
    turned by k strides, gives any of the set's elements.
    """
    sizes = np.array([len(s) for s in sets])
    begins = np.cumsum(sizes) - sizes
    folded = (np.concatenate(sets) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(32)).astype(np.uint32)
    spare, turned = np.empty_like(folded), np.empty_like(folded)
    placed = _permuted(folded, np.empty_like(folded), spare) ^ np.uint32(0x5BD1E995)
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        np.subtract(placed, np.uint32(k * int(_STRIDE) % 2**32), out=turned)
        out[:, k] = np.minimum.reduceat(_permuted(turned, turned, spare), begins)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * rows + r])
        out[:, b] = key
    return out


def sketches(docs: DataFrame, *, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (BLAKE2b of the whole sorted set, 128 bits), bands (one key each; empty if the set is)."""
    schema = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_values(batch.column(1))
            for first, last in chunks(offsets):
                sets = shingle_sets([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)], size)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                whole = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), np.int64).reshape(-1, 2)
                keys = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows) if len(full) else np.zeros((0, bands), np.uint64)
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(sizes), pa.array(whole[:, 0]), pa.array(whole[:, 1]), lists],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first set of its component, where sets with 100 * common >= percent * union are linked.

    Exact: sets are taken by size and compared with those before that share one
    of their rarest elements (two such sets must), not yet known to be in the
    same component, and of no less than percent of their size.
    """
    n = len(sets)
    label = np.arange(n)
    if n < 2:
        return label
    sizes = np.array([len(s) for s in sets])
    _, back, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    ranks = [np.sort(x) for x in np.split(rank[back], np.cumsum(sizes)[:-1])]
    order = np.argsort(sizes, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    prefix = sizes - -(-percent * sizes // 100) + 1
    heads = [r[:p] for r, p in zip(ranks, prefix, strict=True)]
    token = np.concatenate([heads[i] for i in order])
    holder = np.repeat(np.arange(n), prefix[order])
    by = np.argsort(token, kind="stable")
    token, holder = token[by], holder[by]
    low = np.searchsorted(token, np.arange(len(often)))
    high = np.searchsorted(token, np.arange(len(often)), "right")
    mark = np.zeros(len(often), bool)
    by_size = sizes[order]
    for at in range(1, n):
        me = order[at]
        least = np.searchsorted(by_size, -(-percent * sizes[me] // 100))
        if least >= at:
            continue
        parts = []
        for t in heads[me]:
            if high[t] - low[t] > 1:
                own = holder[low[t] : high[t]]
                parts.append(own[np.searchsorted(own, least) : np.searchsorted(own, at)])
        if not parts:
            continue
        near, shared = np.unique(np.concatenate(parts), return_counts=True)
        near = order[near[np.argsort(-shared, kind="stable")]]
        near = near[label[near] != label[me]]
        if not len(near):
            continue
        mark[ranks[me]] = True
        while len(near):
            other = near[0]
            common = int(mark[ranks[other]].sum())
            if 100 * common >= percent * (sizes[me] + sizes[other] - common):
                a, b = sorted((label[me], label[other]))
                label[label == b] = a
                near = near[label[near] != label[me]]
            else:
                near = near[1:]
        mark[ranks[me]] = False
    return label


def _verified(members: DataFrame, size: int, percent: int) -> DataFrame:
    """node, root within each cell, from texts that are dealt out and sorted by cell."""
    rows = members.repartition("family", "left", "right").sortWithinPartitions("family", "left", "right", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        nodes: list[int] = []
        sets: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            label = linked(sets, percent)
            ids = np.array(nodes, np.int64)
            for i in np.flatnonzero(ids[1:] == ids[:-1]):  # texts that share an id are one node
                label[label == label[i + 1]] = label[i]
            root = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(root, label, ids)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root[label])], names=["node", "root"])

        for batch in batches:
            data, offsets = byte_values(batch.column(4))
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            for first, last in chunks(offsets):
                own = shingle_sets([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)], size)
                for (*key, node), shingles in zip(keys[first:last], own, strict=True):
                    if (key := tuple(key)) != cell:
                        if nodes:
                            yield out()
                        cell, nodes, sets = key, [], []
                    again = len(nodes)
                    while again and nodes[again - 1] == node and not np.array_equal(sets[again - 1], shingles):
                        again -= 1
                    if not again or nodes[again - 1] != node:  # not a row that repeats an id and its set
                        nodes.append(node)
                        sets.append(shingles)
        if nodes:
            yield out()

    return rows.select("family", "left", "right", "node", "text").mapInArrow(run, "node long, root long")


def near_duplicates(docs: DataFrame, *, percent: int = 80, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    1. Sketches: signature, band keys and a 128-bit cryptographic hash of the whole shingle set.
    2. Equal sets form a class; its smallest id, the node, alone goes on.
    3. In each bucket of a band, members are tied to the smallest (a star, never all pairs);
       components of these unverified ties are families.
    4. A family's texts meet in one cell, where links are verified on full sets. A family of more
       than ``cell_shingles`` shingles is dealt into blocks, and each two blocks make a cell: no pair is lost.
    5. component_id is the smallest id that verified links reach.

    Defined cases: a text without words, or null, has no shingles and is linked
    with nothing; a null id has no component and is not kept; rows that repeat
    an id are one node, with the links of all its texts; equal sets are linked
    whatever their texts are; columns but doc_id and text are not read.
    """
    spark = docs.sparkSession
    where = shared_dir(spark)
    sketch = written(sketches(docs, size=size, bands=bands, rows=rows), f"{where}/sketches")
    full = sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    with scratch(spark):
        classes = written(full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node")), shared_dir(spark))
        members = written(full.join(classes, ["f1", "f2", "n_shingles"]).select("doc_id", "node", "n_shingles", F.when(F.col("doc_id") == F.col("node"), F.col("bands")).alias("bands")), f"{where}/members")

        keys = members.where(F.col("bands").isNotNull()).select("node", F.explode("bands").alias("key"))
        stars = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where(F.col("pivot") < F.col("top")).drop("top")
        ties = keys.join(stars, "key").where(F.col("node") != F.col("pivot")).select(F.col("node").alias("u"), F.col("pivot").alias("v"))
        families = components(ties)

        sizes = members.where(F.col("bands").isNotNull()).groupBy("node").agg(F.max("n_shingles").alias("n"))
        placed = families.join(sizes, "node").select("node", F.col("root").alias("family"), "n")
        blocks = placed.groupBy("family").agg(F.ceil(F.sum("n") * 2 / F.lit(float(cell_shingles))).alias("blocks"))
        blocks = blocks.withColumn("blocks", F.when(F.col("blocks") <= 2, F.lit(1)).otherwise(F.col("blocks")).cast("int"))
        placed = written(placed.join(blocks, "family").select("node", "family", "blocks"), shared_dir(spark))
        mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        cells = placed.withColumn("mine", mine).select("node", "family", "mine", other.alias("other")).select(
            "node", "family", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right")
        )
        texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text"))
        links = written(_verified(texts.join(cells, "node"), size, percent), f"{where}/links")
        # an id of several texts ties the nodes of all of them
        several = members.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("top")).where(F.col("least") < F.col("top"))
        shared = written(members.join(several, "doc_id").where(F.col("node") != F.col("least")).select(F.col("node").alias("u"), F.col("least").alias("v")).distinct(), shared_dir(spark))
        if shared.limit(1).count() or placed.where(F.col("blocks") > 1).limit(1).count():
            links = written(components(links.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(shared)), f"{where}/components")
    found = members.select("doc_id", "node").join(links.where(F.col("node") != F.col("root")).distinct(), "node", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("root", "node")).alias("component_id")
    )
    every = sketch.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return every.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


_A_TO_Z = "".join(map(chr, range(65, 91)))
#: For rows that have an id, at 85 percent.
ORACLE_SQL = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A_TO_Z}', '{_A_TO_Z.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT row, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s FROM (
  SELECT row, w, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT row, count(*) AS n FROM shingles GROUP BY row),
sized AS (SELECT row, s, n FROM shingles JOIN sizes USING (row)),
pairs AS (SELECT a.row AS u, b.row AS v FROM sized a JOIN sized b ON a.s = b.s AND a.row < b.row AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.row, b.row HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))),
edges AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs UNION
  SELECT a.row, b.row FROM docs a JOIN docs b USING (doc_id) JOIN sizes x ON x.row = a.row JOIN sizes y ON y.row = b.row WHERE a.row <> b.row),
reached AS (SELECT row AS u, row AS v FROM sizes UNION SELECT r.u, e.v FROM reached r JOIN edges e ON e.u = r.v),
roots AS (SELECT u AS row, min(doc_id) AS root FROM reached JOIN docs ON docs.row = v GROUP BY u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM docs LEFT JOIN sizes USING (row) LEFT JOIN roots USING (row)
"""
