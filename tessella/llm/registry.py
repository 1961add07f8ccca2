"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tessella.llm import bpe, chat, collocation, decontam, html_extract, jaccard, merkle, parts, pii, quality, secret_scan, toxicity, url_filter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_quality": quality.op2_quality,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_near_components": jaccard.op5_near_components,
    "op6_secrets": secret_scan.op6_secrets,
    "op7_decontam": decontam.op7_decontam,
    "op8_chat": chat.op8_chat,
    "op9_pii": pii.op9_pii,
    "op10_main_text": html_extract.op10_main_text,
    "op11_merkle": merkle.op11_merkle,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_collocations": collocation.op13_collocations,
}

ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op2_quality": quality.OP2_SQL,
    "op5_near_components": jaccard.OP5_SQL,
    "op8_chat": chat.OP8_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op13_collocations": collocation.OP13_SQL,
}

#: Columns of op3, op4, op6 and op9 that SQL can express, and their SQL.
PARTS, PARTS_SQL = parts.QUERIES, parts.ORACLE_SQL
