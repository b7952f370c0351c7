"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import balltree_topk, bpe_lexicon, delta_lloyd, hard_negatives, imi_search, line_dedup, pii, quality_pu, source_mixing, substring_dedup, suffix_dedup, toxicity, weighted_minhash

QUERIES = {
    "op1_compact_windows": substring_dedup.query,
    "op2_quality_pu": quality_pu.query,
    "op3_pii": pii.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_inverted_multi_index": imi_search.query,
    "op6_bpe_lexicon": bpe_lexicon.query,
    "op7_line_dedup": line_dedup.query,
    "op8_weighted_minhash": weighted_minhash.query,
    "op9_source_mixing": source_mixing.query,
    "op10_balltree_topk": balltree_topk.query,
    "op11_delta_lloyd": delta_lloyd.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_weak_toxicity": toxicity.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op9_source_mixing": source_mixing.ORACLE,
    "op10_balltree_topk": balltree_topk.ORACLE,
    "op11_delta_lloyd": delta_lloyd.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
