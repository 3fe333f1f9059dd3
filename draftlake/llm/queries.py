"""The queries of this subpackage and the SQL that checks them, by name."""

from __future__ import annotations

from . import cotraining, decontaminate, language_model, near_duplicates, quality_rules, secrets, suffix_dedup, token_records, unigram, url_filters

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op10_language_model": language_model.op10_language_model,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_token_records": token_records.op3_token_records,
    "op4_quality_classifier": cotraining.op4_quality_classifier,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_sentencepiece": unigram.op7_sentencepiece,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_near_duplicates": near_duplicates.op9_near_duplicates,
}

ORACLE_SQL = {
    "op1_secret_scans": secrets.ORACLE_SQL,
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op6_url_filters": url_filters.ORACLE_SQL,
    "op8_quality_rules": quality_rules.ORACLE_SQL,
    "op9_near_duplicates": near_duplicates.ORACLE_SQL,
}
