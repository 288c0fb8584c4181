"""Registered queries of the corpus operators and their SQL, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointlake.llm import bpe, decontam, langid, licenses, lm_score, pii, pu_quality, quality_rules, simhash, token_rollup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontam.op1_decontamination,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_language_id": langid.op3_language_id,
        "op4_bpe": bpe.op4_bpe,
        "op5_simhash_dedup": simhash.op5_simhash_dedup,
        "op6_pii": pii.op6_pii,
        "op7_token_counts": token_rollup.op7_token_counts,
        "op8_quality_classifier": pu_quality.op8_quality_classifier,
        "op9_lm_scoring": lm_score.op9_lm_scoring,
        "op10_license_scan": licenses.op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_pii": pii.digest_sql(),
        "op7_token_counts": token_rollup.OP7_SQL,
        "op10_license_scan": licenses.digest_sql(),
    }
