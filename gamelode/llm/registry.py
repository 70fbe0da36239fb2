"""Queries of this subpackage, and SQL for those that it can express."""

from . import chaining, exact_dedup, mixing, piece_dropout, quality, simhash, suffix_dedup, toxicity, url_filter, va_file

QUERIES = {
    "op1_collinear_chaining": chaining.query,
    "op2_va_file_top_k": va_file.query,
    "op3_piece_dropout": piece_dropout.query,
    "op4_mix_sources": mixing.query,
    "op5_quality_classifier": quality.query,
    "op6_url_filter": url_filter.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_toxicity": toxicity.query,
    "op10_exact_dedup": exact_dedup.query,
}
ORACLES = {
    "op2_va_file_top_k": va_file.SQL,
    "op6_url_filter": url_filter.sql(),
    "op8_suffix_dedup": suffix_dedup.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
