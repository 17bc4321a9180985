"""The text operators' registered queries, one opN_<name> each, and the SQL of those that SQL can express."""

from __future__ import annotations

from treefuse.llm import bpe, chat_format, decontaminate, jaccard_join, licenses, near_dedup, nearest, quality, resample, suffix_dedup, token_align, url_filter, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_warc": warc.op2_warc,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_bpe": bpe.op5_bpe,
    "op6_licenses": licenses.op6_licenses,
    "op7_nearest": nearest.op7_nearest,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_quality": quality.op10_quality,
    "op11_resample": resample.op11_resample,
    "op12_token_align": token_align.op12_token_align,
    "op13_jaccard_join": jaccard_join.op13_jaccard_join,
}
ORACLE = {
    "op1_suffix_dedup": suffix_dedup.SQL,
    "op2_warc": warc.SQL,
    "op3_near_dedup": near_dedup.SQL,
    "op4_url_filter": url_filter.SQL,
    "op8_chat_format": chat_format.SQL,
    "op6_licenses": licenses.SQL,
    "op7_nearest": nearest.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_resample": resample.SQL,
    "op13_jaccard_join": jaccard_join.SQL,
}
