"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from quarrykit.llm import chat, decontam, html_text, lm_scoring, ngram_join, packing, quality, sharding, suffix_dedup, warc
from quarrykit.shipping import ship


def _shipped(query):
    return lambda spark, sf_dir: query(ship(spark), sf_dir)


QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_sharding": sharding.query,
    "op3_lm_scoring": lm_scoring.query,
    "op4_chat_formatting": chat.query,
    "op5_warc": warc.query,
    "op6_ngram_jaccard": ngram_join.query,
    "op7_html_extraction": html_text.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_bestfit_packing": packing.query,
    "op10_decontamination": decontam.query,
}
QUERIES = {name: _shipped(query) for name, query in QUERIES.items()}
ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op2_sharding": sharding.ORACLE,
    "op4_chat_formatting": chat.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_ngram_jaccard": ngram_join.ORACLE,
}
