"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from atrium.llm import (
    classifier, decontamination, jaccard, lines, mixing, periods, rules, sharding, simhash, substrings, toxicity, warc, whitening,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.lines_digest(_table(spark, folder, "documents"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup_digest(_table(spark, folder, "documents"))


def op3_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return warc.revisit_digest(_table(spark, folder, "pages"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.classify_quality(_table(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.judge_quality(_table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_digest(_table(spark, folder, "documents"))


def op9_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_components(_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_digest(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op12_periods(spark: SparkSession, folder: str) -> DataFrame:
    return periods.periods_digest(_table(spark, folder, "documents"))


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_digest(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (
    op1_line_dedup, op2_substring_dedup, op3_warc_revisits, op4_decontamination, op5_mixing, op6_quality_classifier, op7_quality_rules, op8_sharding,
    op9_jaccard, op10_toxicity, op11_whitening, op12_periods, op13_simhash,
)}
ORACLES: dict[str, str] = {"op3_warc_revisits": warc.ORACLE}
