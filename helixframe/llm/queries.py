"""The registered queries of this package and the SQL that some of them can be held against."""

from __future__ import annotations

from . import byte_bpe, packing, quality_classifier, quality_rules, sharding, simhash, token_counts, topk, toxicity, urls


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    found = (
        topk.op1_exact_top_k, token_counts.op2_token_counts, urls.op3_url_filter, simhash.op4_simhash_near_dedup, toxicity.op5_toxicity,
        packing.op6_best_fit_packing, byte_bpe.op7_byte_bpe_round_trip, quality_classifier.op8_quality_classifier, sharding.op9_vector_sharding, quality_rules.op10_quality_rules,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL, where SQL can express the operator."""
    return {"op1_exact_top_k": topk.OP1_SQL, "op3_url_filter": urls.OP3_SQL}
