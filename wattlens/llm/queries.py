"""Queries of the llm operators over the given tables, and their SQL where SQL can express them."""
from __future__ import annotations

from wattlens.llm import (hnsw, html_text, language, licenses, merkle, mixing, packing, periodic_runs, pii,
                          quality, sharding, shingle_join, tokens)

QUERIES = {
    "op1_hypergeometric_shards": sharding.op1_hypergeometric_shards,
    "op2_hnsw_near_dedup": hnsw.op2_hnsw_near_dedup,
    "op3_string_kernel_language": language.op3_string_kernel_language,
    "op4_surrogate_pii": pii.op4_surrogate_pii,
    "op5_parity_sketch_join": shingle_join.op5_parity_sketch_join,
    "op6_text_density": html_text.op6_text_density,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_soft_mixing": mixing.op8_soft_mixing,
    "op9_mcd_quality": quality.op9_mcd_quality,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_scale_tiled_runs": periodic_runs.op11_scale_tiled_runs,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_diagonal_licenses": licenses.op13_diagonal_licenses,
}
ORACLE: dict[str, str] = {"op5_parity_sketch_join": shingle_join.OP5_SQL, "op12_merkle_manifest": merkle.OP12_SQL}
