"""The queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tidelake.llm import byte_bpe, decontaminate, license_scan, line_dedup, lm_scoring, near_dedup, quality_rules, secret_scan, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_byte_bpe": byte_bpe.op2_byte_bpe,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_lm_scoring": lm_scoring.op7_lm_scoring,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.SQL,
        "op4_decontaminate": decontaminate.SQL,
        "op5_secret_scan": secret_scan.SQL,
        "op8_near_dedup": near_dedup.SQL,
        "op10_quality_rules": quality_rules.SQL,
    }
