"""The queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

from tidemark.llm import byte_bpe, chat, fingerprint, html_text, language, mixing, near_dup, quality, token_files, toxicity

QUERIES = {
    "op1_temperature_mixing": mixing.query,
    "op2_near_duplicates": near_dup.query,
    "op3_main_text": html_text.query,
    "op4_line_quality": quality.query,
    "op5_byte_bpe": byte_bpe.query,
    "op6_language_mixture": language.query,
    "op7_lookup_sketches": fingerprint.query,
    "op8_reply_trees": chat.query,
    "op9_token_files": token_files.query,
    "op10_weak_toxicity": toxicity.query,
}

ORACLE_SQL = {"op8_reply_trees": chat.ORACLE_SQL}
