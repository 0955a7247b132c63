"""Queries of the training-data operators and the SQL they must agree with."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, html_text, jaccard_join, linededup, packing, quality_model, quality_rules, repair, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_edit_aware_token_counts": token_counts.op1_edit_aware_token_counts,
        "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
        "op3_repair_token_output": repair.op3_repair_token_output,
        "op4_html_extraction": html_text.op4_html_extraction,
        "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_quality_classifier": quality_model.op9_quality_classifier,
        "op10_line_dedup": linededup.op10_line_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": jaccard_join.OP2_SQL,
        "op8_quality_rules": quality_rules.OP8_SQL,
        "op10_line_dedup": linededup.OP10_SQL,
    }
