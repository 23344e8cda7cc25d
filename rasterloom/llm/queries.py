"""The registered queries of this folder and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, exact_topk, license_scan, merkle_manifest, mixing, piece_lattice, simhash_dedup, substring_dedup, token_alignment, token_files, toxicity, url_filter, vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_nearest_vectors": vector_search.op5_nearest_vectors,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_simhash_near_dedup": simhash_dedup.op7_simhash_near_dedup,
    "op8_token_files": token_files.op8_token_files,
    "op9_sentencepiece": piece_lattice.op9_sentencepiece,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_exact_topk": exact_topk.op13_exact_topk,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op12_merkle_manifest": merkle_manifest.OP12_SQL,
    "op13_exact_topk": exact_topk.OP13_SQL,
}
