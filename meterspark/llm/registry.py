"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from meterspark.llm import alignment, audit, chat, decontam, htmltext, linededup, mixing, pii, quality, simhash, tokens, toxicity, urlfilter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_url_filters": urlfilter.op5_url_filters,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_pii": pii.op9_pii,
    "op10_simhash": simhash.op10_simhash,
    "op11_html_extraction": htmltext.op11_html_extraction,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_filter_audit": audit.op13_filter_audit,
}
ORACLE = {
    "op3_line_dedup": linededup.OP3_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op5_url_filters": urlfilter.OP5_SQL,
    "op7_source_mixing": mixing.OP7_SQL,
    "op13_filter_audit": audit.OP13_SQL,
}
