"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from skyloom.llm import collocations, embedding_dedup, exact_dedup, language_id, licenses, line_dedup, mixing, near_dedup, packing, quality, substring_dedup, token_alignment, url_filter

QUERIES = {
    "op11_collocations": collocations.op11_collocations,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_url_filter": url_filter.op13_url_filter,
    "op3_quality": quality.op3_quality,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_license_scan": licenses.op10_license_scan,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op1_order_minhash": near_dedup.op1_order_minhash,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op2_language_id": language_id.op2_language_id,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
}

ORACLE = {
    "op11_collocations": collocations.OP11_SQL,
    "op13_url_filter": url_filter.OP13_SQL,
    "op10_license_scan": licenses.OP10_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
}
