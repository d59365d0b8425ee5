"""The operators over their whole tables, one query each, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import (
    byte_bpe, classifier, exact_dedup, html_extract, interaction_audit, line_dedup, mixing, packing, prefix_trie,
    quality_rules, simhash, token_counts, url_filter,
)
from pairloom.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return classifier.digest(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digest(read_table(spark, sf_dir, "pages", "page_id", "url"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return interaction_audit.digest(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_quality_classifier, op3_simhash_near_dedup, op4_mix_sources, op5_exact_dedup, op6_line_dedup,
        op7_best_fit_packing, op8_url_filter, op9_quality_rules, op10_html_extraction, op11_byte_bpe,
        op12_prefix_trie, op13_filter_interactions,
    )
}
TWINS = {
    "op5_exact_dedup": exact_dedup.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op8_url_filter": url_filter.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_filter_interactions": interaction_audit.SQL,
}
