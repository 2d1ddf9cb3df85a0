"""Registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.llm import byte_bpe, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, line_dedup, merkle, mixing, oracle, periodic_runs, quality_rules, substring_dedup, toxicity


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> tuple[str, str]:
    """Rank file and split pattern of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_shared")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(read(spark, sf_dir, "documents"), *vocabulary()).select(
        "doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rows(read(spark, sf_dir, "documents")).drop("rejected_by")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return merkle.manifest(docs, claimed=merkle.tampered(docs), proofs=False)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return periodic_runs.digest(periodic_runs.periodic_runs(docs.select("doc_id", periodic_runs.planted(docs).alias("text"))))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_mixing, op2_html_extraction, op3_language_id, op4_line_dedup, op5_byte_bpe, op6_quality_rules, op7_jaccard_join,
    op8_substring_dedup, op9_toxicity, op10_exact_dedup, op11_merkle_manifest, op12_periodic_runs,
    op13_decontamination)}

ORACLE: dict[str, str] = {"op1_mixing": oracle.MIXING, "op4_line_dedup": line_dedup.ORACLE, "op6_quality_rules": oracle.QUALITY, "op10_exact_dedup": oracle.EXACT,
                          "op11_merkle_manifest": merkle.ORACLE, "op13_decontamination": decontaminate.ORACLE}
