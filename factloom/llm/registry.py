"""The corpus operators' queries by name, and SQL for those that it can express."""

from __future__ import annotations

from factloom.llm import chat, embedding, langid, mixing, packing, quality, sharding, simhash, substring, tokens

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_packing": packing.query,
    "op3_substring_dedup": substring.query,
    "op4_simhash_dedup": simhash.query,
    "op5_embedding_dedup": embedding.query,
    "op6_token_output": tokens.query,
    "op7_mixing": mixing.query,
    "op8_language_id": langid.query,
    "op9_chat_formatting": chat.query,
    "op10_quality_rules": quality.query,
}

ORACLES = {
    "op1_sharding": sharding.ORACLE,
    "op2_packing": packing.ORACLE,
    "op3_substring_dedup": substring.ORACLE,
    "op4_simhash_dedup": simhash.ORACLE,
    "op5_embedding_dedup": embedding.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
    "op10_quality_rules": quality.ORACLE,
}
