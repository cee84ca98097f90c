"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from webloom.llm import bpe, language_id, lm_scoring, media, mixing, ngram_join, pii, quality_mil, quality_rules, spelling, substring_dedup, vector_codes, wrappers

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_language_id": language_id.query,
    "op3_bpe": bpe.query,
    "op4_quality_mil": quality_mil.query,
    "op5_pii": pii.query,
    "op6_lm_scoring": lm_scoring.query,
    "op7_media": media.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_ngram_join": ngram_join.query,
    "op10_mixing": mixing.query,
    "op11_vector_codes": vector_codes.query,
    "op12_spelling": spelling.query,
    "op13_wrappers": wrappers.query,
}

ORACLE_SQL: dict[str, str] = {
    "op10_mixing": mixing.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op12_spelling": spelling.ORACLE_SQL,
}
