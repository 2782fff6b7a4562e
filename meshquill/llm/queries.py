"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import conversations, exact_dedup, filter_audit, language, licenses, mixing, near_dedup, ngram_join, packing, quality, tokens, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_language_id": language.op5_language_id,
    "op6_poisson_mix": mixing.op6_poisson_mix,
    "op7_warc_merge": warc.op7_warc_merge,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_packing": packing.op10_packing,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_ngram_join": ngram_join.op13_ngram_join,
}

ORACLES = {
    "op4_license_scan": licenses.oracle_sql(),
    "op6_poisson_mix": mixing.ORACLE_SQL,
    "op7_warc_merge": warc.ORACLE_SQL,
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_conversation_repair": conversations.ORACLE_SQL,
}
