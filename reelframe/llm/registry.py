"""The subpackage's queries and their SQL."""

from __future__ import annotations

from reelframe.llm import additive_codes, chat_format, hamming_search, html_text, language_id, length_buckets, near_dups, pipeline, soft_mixing, toxicity, url_rules


def queries() -> dict:
    return {
        "op1_url_rules": url_rules.query,
        "op2_hamming_search": hamming_search.query,
        "op3_additive_codes": additive_codes.query,
        "op4_html_text": html_text.query,
        "op5_length_buckets": length_buckets.query,
        "op6_soft_mixing": soft_mixing.query,
        "op7_toxicity": toxicity.query,
        "op8_near_dups": near_dups.query,
        "op9_language_id": language_id.query,
        "op10_chat_format": chat_format.query,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_rules": url_rules.SQL, "op2_hamming_search": hamming_search.SQL, "op5_length_buckets": length_buckets.SQL, "op8_near_dups": near_dups.SQL, "op10_chat_format": chat_format.SQL}
