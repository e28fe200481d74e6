"""A training corpus from raw documents: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, minhash, sentencepiece
from .common import dropped, scratch, shared_dir, table, written

#: The model file of the last stage.
PIECES = sentencepiece.MODEL_PATH
#: Words that its tasks remember: less than by itself, as workers also hold what earlier stages needed.
WORDS = 400_000


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has; text that no model explains goes."""
    found = language_id.identify(docs, language_id.learn(docs)).where("rejected").select(F.col("doc_id").alias("bad_id"), "doc_key").distinct()
    same = docs["doc_id"].eqNullSafe(F.col("bad_id")) & (F.xxhash64(docs["doc_id"], docs["text"]) == F.col("doc_key"))
    return docs.join(found, same, "left_anti")


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines leave the text; documents that have nothing else left go."""
    kept = line_dedup.line_dedup(docs)
    kept = kept.where((F.col("n_removed_lines") == 0) | (F.length("text") > 0))
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of two lines or more leave the text whole, so a copy of several lines has nothing left and goes."""
    kept = line_dedup.passage_dedup(docs)
    kept = kept.where((F.col("n_removed_lines") == 0) | (F.length("text") > 0))
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and its ids, with their number, and the digests of ids and of a decoded copy."""
    return sentencepiece.round_trip(docs, sentencepiece.read_model(PIECES), words=WORDS, with_ids=True)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

#: The same with whole passages for chunks. STAGES keeps chunks, as its tests state them.
PASSAGE_STAGES = [(name, remove_repeated_passages if name == "line_dedup" else stage) for name, stage in STAGES]

#: Models, components and pieces have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def _through(stages: list, spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage writes on its way goes when its own table is written, and that goes when the next stage's is; the last but one stays, as the result is read from it."""
    docs, where, before = table(spark, sf_dir, "documents"), shared_dir(spark), None
    for name, stage in stages[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"{where}/{name}")
        if before:
            dropped(spark, before)
        before = f"{where}/{name}"
    return stages[-1][1](spark, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(STAGES, spark, sf_dir)


def run_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(PASSAGE_STAGES, spark, sf_dir)
