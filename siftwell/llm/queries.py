"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import chats, decontaminate, language, packing, pages, simhash, substrings, tokens, vectors, wavelet

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_token_shards": wavelet.op2_token_shards,
    "op3_chat_examples": chats.op3_chat_examples,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_embedding_dedup": vectors.op5_embedding_dedup,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_html_text": pages.op7_html_text,
    "op8_simhash_dedup": simhash.op8_simhash_dedup,
    "op9_language_id": language.op9_language_id,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op3_chat_examples": chats.OP3_SQL,
    "op4_substring_dedup": substrings.OP4_SQL,
    "op5_embedding_dedup": vectors.OP5_SQL,
}
