"""The queries of this subpackage, by name, and the SQL that checks them which SQL can express."""

from __future__ import annotations

from dyadflow.llm import chat, decontaminate, html, lines, mixing, near, phrases, quality, shards, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_ngram_jaccard": near.op3_ngram_jaccard,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_sharding": shards.op5_sharding,
    "op6_html": html.op6_html,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_fingerprints": phrases.op9_fingerprints,
    "op10_chat": chat.op10_chat,
}
ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_line_dedup": lines.OP2_SQL,
    "op3_ngram_jaccard": near.OP3_SQL,
    "op4_decontamination": decontaminate.OP4_SQL,
    "op5_sharding": shards.OP5_SQL,
    "op10_chat": chat.OP10_SQL,
}
