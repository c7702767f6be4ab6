"""Queries op1 to op10, each over its whole tables. The pipeline is in corpus_pipeline.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstrata.llm import chat, chunkdedup, decontam, hostrules, htmlextract, linededup, packing, quality, simhash, tokencount
from inkstrata.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.repeated_spans(table(spark, sf_dir, "documents")).drop("text_key")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "kept_text_key")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_runs(table(spark, sf_dir, "documents")).drop("text_key")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op6_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract_pages(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_best_fit_packing,
        op2_substring_dedup,
        op3_simhash_near_dedup,
        op4_line_dedup,
        op5_benchmark_decontamination,
        op6_host_quality_rules,
        op7_html_extraction,
        op8_token_counts,
        op9_quality_classifier,
        op10_chat_formatting,
    )
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": linededup.ORACLE,
    "op6_host_quality_rules": hostrules.ORACLE,
    "op10_chat_formatting": chat.ORACLE,
}
