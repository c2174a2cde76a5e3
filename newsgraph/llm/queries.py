"""One query per operator, over whole tables with the operators' own parameters, and their SQL."""

from __future__ import annotations

from . import exact_dedup, licenses, mixing, near_dedup, packing, quality, spelling, substring_dedup, toxicity, url_filter, vector_search, warc, whitening

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_exact_top_k": vector_search.query,
    "op3_warc": warc.query,
    "op4_simhash_near_dedup": near_dedup.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_mixing": mixing.query,
    "op7_url_filter": url_filter.query,
    "op8_license_scan": licenses.query,
    "op9_quality": quality.query,
    "op10_packing": packing.query,
    "op11_toxicity": toxicity.query,
    "op12_spelling_variants": spelling.query,
    "op13_whitening": whitening.query,
}
ORACLES = {
    "op2_exact_top_k": vector_search.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op7_url_filter": url_filter.ORACLE_SQL,
}
