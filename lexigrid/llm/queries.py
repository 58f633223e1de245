"""The registered queries of this subpackage, and their DuckDB equivalents."""

from __future__ import annotations

from lexigrid.llm import bpe, decontaminate, langid, licenses, ngram_lm, pii, quality, secrets, simhash, spelling, substring_dedup, token_files, vector_codes

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_language_id": langid.op3_language_id,
    "op4_pii": pii.op4_pii,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_lm_scoring": ngram_lm.op9_lm_scoring,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_token_files": token_files.op11_token_files,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

#: Where SQL can express the whole result; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": decontaminate.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op8_secret_scan": secrets.ORACLE,
    "op10_license_scan": licenses.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
