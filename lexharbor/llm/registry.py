"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import packing, passages, pieces, pylm, quality, secrets, sharding, simhash, tokenfiles, topk


def queries() -> dict:
    return {f.__name__: f for f in (secrets.op1_secret_scans, pylm.op2_pitman_yor, quality.op3_quality_rules, topk.op4_dual_tree_topk, tokenfiles.op5_token_tables, packing.op6_best_fit_packing, simhash.op7_simhash_bktree, pieces.op8_sentencepiece, sharding.op9_extendible_sharding, passages.op10_compact_windows)}


def oracle_sql() -> dict[str, str]:
    return {"op4_dual_tree_topk": topk.SQL, "op9_extendible_sharding": sharding.SQL}
