"""Operators for training-data pipelines.  Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_extraction, line_dedup, mixing, ngram_join, pii, quality_rules, rule_ensemble, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_quality_classifier": rule_ensemble.op3_quality_classifier,
    "op4_ngram_jaccard": ngram_join.op4_ngram_jaccard,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_pii": pii.op6_pii,
    "op7_mixing": mixing.op7_mixing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_html_extraction": html_extraction.op10_html_extraction,
}
#: op3, op6, op9 and op10 learn, return match positions or parse markup: SQL can't express them; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op2_url_filters": url_filters.OP2_SQL,
    "op4_ngram_jaccard": ngram_join.OP4_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
}
