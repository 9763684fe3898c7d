"""Queries and SQL of this folder."""

from __future__ import annotations

from . import chat_format, decontaminate, html_extract, language_id, merkle_manifest, near_dedup, neighbours, ngram_lm, packing, quality_rules, token_alignment, token_output, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_token_output": token_output.op2_token_output,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_ngram_lm": ngram_lm.op7_ngram_lm,
    "op8_packing": packing.op8_packing,
    "op9_language_id": language_id.op9_language_id,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_nearest_neighbours": neighbours.op11_nearest_neighbours,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}
ORACLE = {"op5_quality_rules": quality_rules.ORACLE, "op13_merkle_manifest": merkle_manifest.ORACLE}
