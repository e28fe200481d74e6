"""De-duplication of multi-line chunks with content-defined boundaries, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import document_key, packed, unpacked

#: A line ends a chunk where the rolling hash of it and the line before divides by this: chunks of as many lines on average.
DIVISOR = 4
#: Factor of the line before in the rolling hash.
FACTOR = 31


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunked(text: Column, divisor: int = DIVISOR) -> Column:
    """Array of (first, lines, body): the text's chunks in order; joined by line breaks they give the text again."""

    def of(lines: Column) -> Column:
        def cut(hashes: Column) -> Column:
            rolled = F.transform(hashes, lambda h, i: h + FACTOR * F.coalesce(F.get(hashes, i - 1), F.lit(0).cast("long")))
            marked = F.transform(rolled, lambda r, i: F.when((r % divisor == 0) | (i == F.size(lines) - 1), i))
            return F.filter(marked, lambda i: i.isNotNull())

        def split(ends: Column) -> Column:
            starts = F.transform(ends, lambda _, k: F.coalesce(F.get(ends, k - 1), F.lit(-1)) + 1)
            return F.zip_with(starts, ends, lambda a, b: F.struct(
                a.alias("first"), (b - a + 1).alias("lines"), F.array_join(F.slice(lines, a + 1, b - a + 1), "\n").alias("body"),
            ))

        return _let(_let(F.transform(lines, _line_hash), cut), split)

    return _let(F.split(text, "\n", -1), of)


def _without(items: Column, gone: Column) -> Column:
    """The items whose places the sorted array ``gone`` does not list: the runs between them, in one pass."""

    def run(j: Column) -> Column:
        first = F.coalesce(F.get(gone, j - 1) + 1, F.lit(0))
        return F.slice(items, first + 1, F.coalesce(F.get(gone, j), F.array_size(items)) - first)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.array_size(gone)), run))


def line_dedup(docs: DataFrame, *, divisor: int = DIVISOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without repeated chunks, and n_lines, n_removed_lines, n_chunks, n_removed_chunks.

    A chunk of two lines or more that stands in several places is kept at the
    first (smallest id, then line) and taken out elsewhere. Boundaries depend
    on a line and the one before, so that lines put in or taken out move none
    but the next. Chunks are grouped by 128 bits of hash and by their bytes;
    grouping is partial before the shuffle, and what is to go is given back by
    an equi-join that adaptive execution may split where a chunk is hot.

    Defined cases: a null text stays null and has no lines, an empty one has
    one; null ids come first; rows that repeat id and text are one document
    and lose nothing to each other; a document may become empty; columns that
    have a result's name are replaced.
    """
    names = docs.columns
    rows = packed(docs, doc_id=F.col(id_col), doc_key=document_key(id_col, text_col))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), document_key(id_col, text_col).alias("doc_key"), F.col(text_col).alias("body"))
    pieces = texts.select("doc_id", "doc_key", F.posexplode(chunked(F.col("body"), divisor)).alias("place", "c")).select("doc_id", "doc_key", "place", "c.lines", "c.body").where(F.col("lines") > 1)
    keys = {"h1": F.xxhash64("body"), "h2": F.xxhash64(F.lit("second half"), "body")}
    place = F.struct("doc_id", "doc_key", "place")
    groups = (
        pieces.withColumns(keys).groupBy("h1", "h2", "body").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1).select("h1", "h2", F.md5("body").alias("h3"), "keep")
    )
    light = pieces.select("doc_id", "doc_key", "place", *[c.alias(k) for k, c in keys.items()], F.md5("body").alias("h3"))
    gone = light.join(groups, ["h1", "h2", "h3"]).where(~place.eqNullSafe(F.col("keep")))
    gone = gone.groupBy("doc_key", F.col("doc_id").alias("gone_id")).agg(F.array_sort(F.collect_set("place")).alias("gone"))
    same = (rows["doc_key"] == gone["doc_key"]) & rows["doc_id"].eqNullSafe(gone["gone_id"])
    both = rows.join(gone, same, "left").select("row", chunked(F.col("row")[text_col], divisor).alias("chunks"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    lines = F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + c["lines"])
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda n, k: n + F.get(F.col("chunks"), k)["lines"])
    found = both.select(
        "row", F.array_join(F.transform(_without(F.col("chunks"), F.col("gone")), lambda c: c["body"]), "\n").alias(text_col),
        F.coalesce(lines, F.lit(0).cast("long")).alias("n_lines"), removed.alias("n_removed_lines"),
        F.coalesce(F.array_size("chunks"), F.lit(0)).cast("long").alias("n_chunks"), F.array_size("gone").cast("long").alias("n_removed_chunks"),
    )
    counts = ["n_lines", "n_removed_lines", "n_chunks", "n_removed_chunks"]
    return unpacked(found, names, text_col, *counts).select(*[c for c in names if c not in counts], *counts)


def passage_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without repeated passages of two lines or more, and n_lines, n_removed_lines.

    Every two adjacent lines are judged, whatever surrounds them: both go where
    the pair stands in an earlier place (smallest id, then line), so a repeated
    passage goes whole, and a copy of several lines becomes empty. A line that
    goes still stands in an earlier place. Pairs are grouped by 128 bits of hash.

    Defined cases are those of :func:`line_dedup`; a pair may overlap with the
    one before, so of a line repeated three times in a row one stays.
    """
    names = docs.columns
    rows = packed(docs, doc_id=F.col(id_col), doc_key=document_key(id_col, text_col))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), document_key(id_col, text_col).alias("doc_key"), F.split(text_col, "\n", -1).alias("lines"))

    def pair(line: Column, i: Column) -> Column:
        two = (line, F.get(F.col("lines"), i + 1))
        return F.struct(i.alias("place"), F.xxhash64(*two).alias("h1"), F.xxhash64(F.lit("second half"), *two).alias("h2"))

    judged = F.transform(F.slice("lines", 1, F.size("lines") - 1), pair)
    pairs = texts.select("doc_id", "doc_key", F.explode(judged).alias("p")).select("doc_id", "doc_key", "p.*")
    place = F.struct("doc_id", "doc_key", "place")
    groups = pairs.groupBy("h1", "h2").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("h1", "h2", "keep")
    gone = pairs.join(groups, ["h1", "h2"]).where(~place.eqNullSafe(F.col("keep")))
    gone = gone.groupBy("doc_key", F.col("doc_id").alias("gone_id")).agg(F.collect_set("place").alias("at"))
    gone = gone.select("doc_key", "gone_id", F.array_sort(F.array_distinct(F.concat("at", F.transform("at", lambda i: i + 1)))).alias("gone"))
    same = (rows["doc_key"] == gone["doc_key"]) & rows["doc_id"].eqNullSafe(gone["gone_id"])
    both = rows.join(gone, same, "left").select("row", F.split(F.col("row")[text_col], "\n", -1).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    found = both.select(
        "row", F.array_join(_without(F.col("lines"), F.col("gone")), "\n").alias(text_col),
        F.coalesce(F.array_size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.array_size("gone").cast("long").alias("n_removed_lines"),
    )
    counts = ["n_lines", "n_removed_lines"]
    return unpacked(found, names, text_col, *counts).select(*[c for c in names if c not in counts], *counts)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_removed_lines", "n_chunks", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line, len(l) AS n FROM split),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines),
rolled AS (SELECT *, h + {FACTOR} * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) AS r FROM hashed),
marked AS (SELECT *, coalesce(sum(CASE WHEN r % {DIVISOR} = 0 THEN 1 ELSE 0 END) OVER
  (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM rolled),
chunks AS (SELECT doc_id, chunk, min(i) AS first, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM marked GROUP BY doc_id, chunk),
judged AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY body, n > 1 ORDER BY doc_id, first) > 1 AS gone FROM chunks),
found AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines, count(*) AS n_chunks,
  count(*) FILTER (gone) AS n_removed_chunks, coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '') AS kept FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_chunks, 0) AS n_chunks,
  coalesce(n_removed_chunks, 0) AS n_removed_chunks, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN found USING (doc_id)
"""

#: Of :func:`passage_dedup`.
PASSAGE_SQL = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM split),
pairs AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM lines),
judged AS (SELECT doc_id, i, line, following IS NOT NULL AND row_number() OVER (PARTITION BY line, following ORDER BY doc_id, i) > 1 AS again FROM pairs),
marked AS (SELECT doc_id, i, line, again OR coalesce(lag(again) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM judged),
found AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS m, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_lines, coalesce(m, 0) AS n_removed_lines, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN found USING (doc_id)
"""
