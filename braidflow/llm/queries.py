"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from braidflow.llm import exact_dedup, html_extraction, line_dedup, mixing, near_dedup, ngram_quality, packing, quality_classifier, substring_dedup, token_counts

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_packing": packing.op7_packing,
    "op8_html_extraction": html_extraction.op8_html_extraction,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_ngram_quality": ngram_quality.op10_ngram_quality,
}

ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
}
