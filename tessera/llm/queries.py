"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from . import chat, embeddings, html, langid, licenses, mixing, ngram_lm, packing, quality, simhash

ORACLES: dict[str, str] = {"op1_chat_perspectives": chat.SQL, "op3_license_scan": licenses.SQL, "op7_embedding_near_dedup": embeddings.SQL, "op9_quality_rules": quality.SQL, "op10_source_mixing": mixing.SQL}


def queries() -> dict:
    return {
        "op1_chat_perspectives": chat.op1_query,
        "op2_best_fit_packing": packing.op2_query,
        "op3_license_scan": licenses.op3_query,
        "op4_language_id": langid.op4_query,
        "op5_simhash_near_dedup": simhash.op5_query,
        "op6_lm_scoring": ngram_lm.op6_query,
        "op7_embedding_near_dedup": embeddings.op7_query,
        "op8_html_extraction": html.op8_query,
        "op9_quality_rules": quality.op9_query,
        "op10_source_mixing": mixing.op10_query,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
