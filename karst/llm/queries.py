"""Registered corpus queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from karst.llm import decontaminate, lm, mixing, neighbours, quality, sharding, simhash, suffixes, tokens, toxicity

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_token_files": tokens.op3_token_files,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_shard": sharding.op5_shard,
    "op6_quality": quality.op6_quality,
    "op7_nearest": neighbours.op7_nearest,
    "op8_mix": mixing.op8_mix,
    "op9_lm_scores": lm.op9_lm_scores,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLES: dict[str, str] = {
    "op2_suffix_dedup": suffixes.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
}
