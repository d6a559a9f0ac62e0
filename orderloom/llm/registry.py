"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, line_dedup, ngram_join, pii, quality_rules, secrets, substring_dedup, suffix_dedup, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_secrets": secrets.op3_secrets,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_pii": pii.op5_pii,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_decontaminate": decontaminate.op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_join": ngram_join.ORACLE_SQL,
        "op6_substring_dedup": substring_dedup.ORACLE_SQL,
        "op7_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op10_decontaminate": decontaminate.ORACLE_SQL,
    }
