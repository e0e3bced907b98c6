"""Queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from driftline.llm import bpe, exact_dedup, fill_in_middle, language_model, lexical_search, line_rules, near_dedup, packing, quality, stream_packing, toxicity, urls, warc


def queries() -> dict:
    return {
        "op1_counterfactual_toxicity": toxicity.query,
        "op2_host_reputation": urls.query,
        "op3_superminhash": near_dedup.query,
        "op4_gru_scores": language_model.query,
        "op5_indexed_warc": warc.query,
        "op6_line_rules": line_rules.query,
        "op7_nbsvm_quality": quality.query,
        "op8_rank_array_bpe": bpe.query,
        "op9_exact_dedup": exact_dedup.query,
        "op10_best_fit_packing": packing.query,
        "op11_fim_chunks": fill_in_middle.query,
        "op12_sum_of_squares": stream_packing.query,
        "op13_maxscore": lexical_search.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_host_reputation": urls.SQL, "op9_exact_dedup": exact_dedup.SQL, "op11_fim_chunks": fill_in_middle.SQL, "op13_maxscore": lexical_search.SQL}
