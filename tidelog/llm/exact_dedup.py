"""Exact de-duplication by content hash, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_dedup(docs: DataFrame, *, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by a 128-bit hash and by their bytes, so that two texts
    that only share a hash stay apart. Grouping is partial before the shuffle:
    a text that a third of all rows hold arrives once from each task. Ids are
    given back by an equi-join without any need to see a group whole, which
    adaptive execution may split when one text is hot.

    Defined cases: a null text counts as empty; a null id is never kept unless
    all ids of its group are null (then keep_id is null and all rows stay);
    rows that repeat an id and its text are one document and share its answer,
    each counting in group_size; other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    body = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    hashed = body.select(
        "doc_id", "body",
        F.xxhash64("body").alias("h1"), F.xxhash64(F.lit("second half"), "body").alias("h2"),
    )
    best = (F.min if keep == "smallest" else F.max)("doc_id")
    groups = (
        hashed.groupBy("h1", "h2", "body").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h1", "h2", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows = hashed.select("doc_id", "h1", "h2", F.sha2("body", 256).alias("text_sha256"))
    return rows.join(groups, ["h1", "h2", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
