"""Queries over the corpus tables, one for each operator, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, line_dedup, lm_score, media, near_dup, packing, pieces, quality, span_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_media_columns": media.op3_media_columns,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_near_dedup": near_dup.op9_near_dedup,
    "op10_substring_dedup": span_dedup.op10_substring_dedup,
}
#: Where SQL can express the result.
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op10_substring_dedup": span_dedup.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
