"""Queries that this subpackage registers, and the SQL of those that have it."""

from __future__ import annotations

from . import (anchors, bpe, classifier, counts, divergence, merkle, mixing, ngram_join, packing,
               pfor, rules, sketch, toxicity)

QUERIES = {
    "op1_bpe_round_trip": bpe.op1_bpe_round_trip,
    "op2_quality_classifier": classifier.op2_quality_classifier,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_best_fit_shards": packing.op4_best_fit_shards,
    "op5_temperature_mixing": mixing.op5_temperature_mixing,
    "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
    "op7_bottom_k_sketch": sketch.op7_bottom_k_sketch,
    "op8_pfor_files": pfor.op8_pfor_files,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_counts": counts.op10_token_counts,
    "op11_substring_dedup": anchors.op11_substring_dedup,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE: dict[str, str] = {
    "op6_ngram_jaccard_join": ngram_join.ORACLE,
    "op11_substring_dedup": anchors.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
