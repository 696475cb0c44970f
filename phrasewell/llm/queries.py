"""The queries of this subpackage: each operator over its whole table, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cube, decontaminate, html_text, license_scan, line_dedup, oracle, quality, simhash_dedup, suffix_dedup, token_store, url_rules
from .common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.visible_text(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_blocks(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_spans(table(spark, sf_dir, "documents"))


def op8_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents"), shortest=1)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mixture(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_html_text, op2_simhash_near_dedup, op3_quality_rules, op4_suffix_array_dedup, op5_url_rules, op6_token_blocks,
    op7_license_scan, op8_fuzzy_line_dedup, op9_decontamination, op10_mixture,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express; tests/llm holds the others against brute force."""
    return oracle.oracle_sql()
