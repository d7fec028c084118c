"""The operators applied to the ``documents`` table, and SQL where it can say the same."""

from __future__ import annotations

from . import best_fit, lm_scoring, manifest, media_jpeg, mixing, ngram_join, packing, phrases, pii, quality_rules, secret_scans, sharding, substring_dedup

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1,
    "op2_secret_scans": secret_scans.op2,
    "op3_packing": packing.op3,
    "op4_substring_dedup": substring_dedup.op4,
    "op5_media_jpeg": media_jpeg.op5,
    "op6_quality_rules": quality_rules.op6,
    "op7_pii": pii.op7,
    "op8_ngram_jaccard_join": ngram_join.op8,
    "op9_sharding": sharding.op9,
    "op10_mixing": mixing.op10,
    "op11_merkle_manifest": manifest.op11,
    "op12_phrase_collocations": phrases.op12,
    "op13_best_fit": best_fit.op13,
}

ORACLE_SQL = {
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op9_sharding": sharding.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_merkle_manifest": manifest.OP11_SQL,
    "op12_phrase_collocations": phrases.OP12_SQL,
}
