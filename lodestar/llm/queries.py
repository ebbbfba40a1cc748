"""Registered queries of the ten operators: each over its whole table, with production parameters."""

from __future__ import annotations

from lodestar.llm import bpe, decontaminate, language, lines, merkle, mixing, quality, recurrent, repair, rules, secrets, setjoin, sharding

QUERIES = {
    "op1_language_id": language.op1,
    "op2_decontaminate": decontaminate.op2,
    "op3_quality_classifier": quality.op3,
    "op4_recurrent_lm": recurrent.op4,
    "op5_line_dedup": lines.op5,
    "op6_jaccard_join": setjoin.op6,
    "op7_secret_scan": secrets.op7,
    "op8_source_mix": mixing.op8,
    "op9_shards": sharding.op9,
    "op10_quality_rules": rules.op10,
    "op11_bpe_encode": bpe.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_conversation_repair": repair.op13,
}

#: Queries that SQL can express too.
ORACLES: dict[str, str] = {
    "op8_source_mix": mixing.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_conversation_repair": repair.ORACLE,
}
