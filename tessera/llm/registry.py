"""The subpackage's queries and their SQL twins, by name."""

from __future__ import annotations

from tessera.llm import oracles, queries

QUERIES = {
    "op1_simhash": queries.op1_simhash,
    "op2_mixing": queries.op2_mixing,
    "op3_language": queries.op3_language,
    "op4_topk": queries.op4_topk,
    "op5_decontamination": queries.op5_decontamination,
    "op6_sharding": queries.op6_sharding,
    "op7_line_dedup": queries.op7_line_dedup,
    "op8_suffix_dedup": queries.op8_suffix_dedup,
    "op9_url_filter": queries.op9_url_filter,
    "op10_toxicity": queries.op10_toxicity,
}

ORACLES = {
    "op2_mixing": oracles.OP2,
    "op4_topk": oracles.OP4,
    "op5_decontamination": oracles.OP5,
    "op7_line_dedup": oracles.OP7,
    "op9_url_filter": oracles.OP9,
}
