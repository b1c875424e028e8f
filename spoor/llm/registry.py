"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import ann, decontaminate, html, langid, linedup, quality, sentencepiece, shard, simhash, toxicity

QUERIES = {
    "op1_shard": shard.op1_shard,
    "op2_line_dedup": linedup.op2_line_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_simhash": simhash.op4_simhash,
    "op5_langid": langid.op5_langid,
    "op6_ann": ann.op6_ann,
    "op7_html": html.op7_html,
    "op8_quality": quality.op8_quality,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_sentencepiece": sentencepiece.op10_sentencepiece,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_shard": shard.ORACLE_SQL,
    "op3_decontaminate": decontaminate.ORACLE_SQL,
}
