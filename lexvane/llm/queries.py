"""The queries of this subpackage, as (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from lexvane.llm import bpe, classifier, hard_negatives, licences, line_dedup, merkle, mixing, near_dup, packing, quality_rules, sharding, topk, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_exact_top_k": topk.query,
    "op3_rendezvous_sharding": sharding.query,
    "op4_minhash_near_dedup": near_dup.query,
    "op5_url_redirects": url_filter.query,
    "op6_licence_scan": licences.query,
    "op7_line_dedup": line_dedup.query,
    "op8_quality_classifier": classifier.query,
    "op9_bpe_trie": bpe.query,
    "op10_best_two_fit": packing.query,
    "op11_source_mix": mixing.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_merkle_manifest": merkle.query,
}

#: The others are beyond SQL: hashed likelihoods (op1), licence automaton (op6), boosted trees (op8), byte-pair encoding (op9, op10).
ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": topk.ORACLE,
    "op3_rendezvous_sharding": sharding.ORACLE,
    "op4_minhash_near_dedup": near_dup.ORACLE,
    "op5_url_redirects": url_filter.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op11_source_mix": mixing.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
