"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from labelwright.llm import chat, fingerprints, html_extract, lattice_sampling, mixing, quality_classifier, quality_rules, simhash, token_counts, url_filters

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_sampled_pieces": lattice_sampling.op3_sampled_pieces,
    "op4_url_filter": url_filters.op4_url_filter,
    "op5_chat_format": chat.op5_chat_format,
    "op6_simhash_neardup": simhash.op6_simhash_neardup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_quality_score": quality_classifier.op8_quality_score,
    "op9_html_text": html_extract.op9_html_text,
    "op10_token_counts": token_counts.op10_token_counts,
}

ORACLES = {"op1_source_mix": mixing.ORACLE, "op5_chat_format": chat.ORACLE}
