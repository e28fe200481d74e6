"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, language_id, license_scan, line_dedup, minhash, pipeline, quality, sentencepiece, suffix_dedup
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(license_scan.document_paths(table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


def line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.passage_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs)).drop("doc_key")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.chat_segments(rows))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"), sentencepiece.read_model())


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "line_passages": line_passages,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op6_minhash": op6_minhash,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_suffix_dedup": op10_suffix_dedup,
    "pipeline": pipeline.run,
    "pipeline_passages": pipeline.run_passages,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "line_passages": line_dedup.PASSAGE_SQL,
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op6_minhash": minhash.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_chat_format": chat_format.ORACLE_SQL,
    "op10_suffix_dedup": suffix_dedup.ORACLE_SQL,
}
