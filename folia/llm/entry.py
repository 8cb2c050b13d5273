"""Registered queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, langid, minmax, packing, pii, quality, secretscan, substring, toxicity, warc

QUERIES = {
    "op1_crf_language_id": langid.op1_crf_language_id,
    "op2_ftrl_toxicity": toxicity.op2_ftrl_toxicity,
    "op3_markov_secrets": secretscan.op3_markov_secrets,
    "op4_warc_salvage": warc.op4_warc_salvage,
    "op5_mixture_packing": packing.op5_mixture_packing,
    "op6_benchmark_decontamination": decontam.op6_benchmark_decontamination,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_minhash_near_dedup": minmax.op8_minhash_near_dedup,
    "op9_ngram_quality": quality.op9_ngram_quality,
    "op10_crf_pii": pii.op10_crf_pii,
}

ORACLE_SQL = {
    "op4_warc_salvage": warc.OP4_SQL,
    "op6_benchmark_decontamination": decontam.OP6_SQL,
    "op7_substring_dedup": substring.OP7_SQL,
    "op8_minhash_near_dedup": minmax.OP8_SQL,
}
