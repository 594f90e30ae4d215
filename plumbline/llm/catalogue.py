"""Queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from plumbline.llm import (
    byte_pairs, collocations, decontamination, html_text, line_dedup, personal_data, pieces, quality_rules, secret_scans, simhash, toxicity,
    warc, whitening,
)

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_pii": personal_data.op7_pii,
    "op8_secret_scans": secret_scans.op8_secret_scans,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_warc": warc.op10_warc,
    "op11_whitening": whitening.op11_whitening,
    "op12_collocations": collocations.op12_collocations,
    "op13_byte_bpe": byte_pairs.op13_byte_bpe,
    "pipeline": corpus_pipeline.run,
}
LLM_ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op8_secret_scans": secret_scans.OP8_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
