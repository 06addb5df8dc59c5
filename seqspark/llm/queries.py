"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import ann, decontaminate, html_extract, language_id, mixing, quality, secret_scan, simhash, token_counts, toxicity

QUERIES = {
    "op1_html_extraction": html_extract.query,
    "op2_source_mixing": mixing.query,
    "op3_toxicity": toxicity.query,
    "op4_simhash": simhash.query,
    "op5_token_counts": token_counts.query,
    "op6_secret_scan": secret_scan.query,
    "op7_quality": quality.query,
    "op8_nearest_neighbours": ann.query,
    "op9_decontamination": decontaminate.query,
    "op10_language_id": language_id.query,
}

ORACLES = {"op2_source_mixing": mixing.ORACLE, "op9_decontamination": decontaminate.ORACLE}
