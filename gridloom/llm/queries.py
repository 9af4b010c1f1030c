"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import html_extract, license_scan, mixing, nn_descent, packing, quality_classifier, quality_rules, simhash_dedup, source_divergence, spelling_variants, suffix_dedup, token_counts, token_files

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_query,
    "op2_suffix_dedup": suffix_dedup.op2_query,
    "op3_simhash_dedup": simhash_dedup.op3_query,
    "op4_best_fit_packing": packing.op4_query,
    "op5_license_scan": license_scan.op5_query,
    "op6_quality_rules": quality_rules.op6_query,
    "op7_source_mixing": mixing.op7_query,
    "op8_html_extraction": html_extract.op8_query,
    "op9_nn_descent": nn_descent.op9_query,
    "op10_token_counts": token_counts.op10_query,
    "op11_token_files": token_files.op11_query,
    "op12_source_divergence": source_divergence.op12_query,
    "op13_spelling_variants": spelling_variants.op13_query,
}

SQL: dict[str, str] = {
    "op6_quality_rules": quality_rules.oracle_sql(),
    "op12_source_divergence": source_divergence.oracle_sql(),
    "op13_spelling_variants": spelling_variants.oracle_sql(),
}
