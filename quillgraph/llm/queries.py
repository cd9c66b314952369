"""The queries of this subpackage and, where SQL can express them, the SQL."""

from __future__ import annotations

from . import chat, html, mixing, neardups, packing, quality, sharding, substrings, topk, urls

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_html_extract": html.op3_html_extract,
    "op4_mixing": mixing.op4_mixing,
    "op5_near_duplicates": neardups.op5_near_duplicates,
    "op6_url_filter": urls.op6_url_filter,
    "op7_sharding": sharding.op7_sharding,
    "op8_chat_format": chat.op8_chat_format,
    "op9_packing": packing.op9_packing,
    "op10_quality_rules": quality.op10_quality_rules,
}

ORACLES = {
    "op1_topk": topk.ORACLE,
    "op6_url_filter": urls.oracle(),
    "op7_sharding": sharding.oracle(),
    "op8_chat_format": chat.ORACLE,
}
