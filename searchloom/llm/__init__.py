"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from __future__ import annotations

from . import chat, conversation_repair, decontam, exact_dedup, html_text, minhash, neighbours, packing, pii, quality, secret_scan, vector_codes, warc

#: Registered queries, and SQL that gives the same rows where SQL can express them.
QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_minhash_dedup": minhash.op2_minhash_dedup,
    "op3_warc": warc.op3_warc,
    "op4_packing": packing.op4_packing,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_html_text": html_text.op6_html_text,
    "op7_pii": pii.op7_pii,
    "op8_quality": quality.op8_quality,
    "op9_tool_call_linking": chat.op9_tool_call_linking,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_neighbours": neighbours.op11_neighbours,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES = {
    "op3_warc": warc.SQL,
    "op9_tool_call_linking": chat.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_conversation_repair": conversation_repair.SQL,
}
