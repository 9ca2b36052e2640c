"""The registered corpus queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import decontaminate, html, licences, minhash, packing, pii, quality, suffixes, topk, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_pii": pii.op2_pii,
    "op3_licences": licences.op3_licences,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_html": html.op5_html,
    "op6_packing": packing.op6_packing,
    "op7_warc": warc.op7_warc,
    "op8_minhash": minhash.op8_minhash,
    "op9_topk": topk.op9_topk,
    "op10_suffixes": suffixes.op10_suffixes,
}
ORACLE_SQL = {
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op8_minhash": minhash.OP8_SQL,
    "op10_suffixes": suffixes.OP10_SQL,
    "op3_licences": licences.OP3_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_topk": topk.OP9_SQL,
}
