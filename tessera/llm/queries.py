"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import chat, decontaminate, embedding_dedup, language, licenses, line_dedup, mixing, quality, simhash, toxicity


def queries() -> dict:
    return {
        "op1_language_id": language.query,
        "op2_license_scan": licenses.query,
        "op3_chat_formatting": chat.query,
        "op4_toxicity": toxicity.query,
        "op5_embedding_near_dedup": embedding_dedup.query,
        "op6_line_dedup": line_dedup.query,
        "op7_benchmark_decontamination": decontaminate.query,
        "op8_simhash_near_dedup": simhash.query,
        "op9_source_mixing": mixing.query,
        "op10_quality_classifier": quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": chat.SQL, "op5_embedding_near_dedup": embedding_dedup.SQL}
