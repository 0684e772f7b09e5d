"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from glimmer.llm import align, chats, decontaminate, html, licenses, mix, nearest, quality, repair, secrets, simhash, syncmers, warc

_QUERIES: dict[str, Callable] = {
    "op1_quality": quality.op1_quality,
    "op2_chats": chats.op2_chats,
    "op3_simhash": simhash.op3_simhash,
    "op4_mix": mix.op4_mix,
    "op5_licenses": licenses.op5_licenses,
    "op6_html": html.op6_html,
    "op7_warc": warc.op7_warc,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_nearest": nearest.op9_nearest,
    "op10_secrets": secrets.op10_secrets,
    "op11_syncmers": syncmers.op11_syncmers,
    "op12_align": align.op12_align,
    "op13_repair": repair.op13_repair,
}
_SQL: dict[str, str] = {
    "op2_chats": chats.OP2_SQL,
    "op5_licenses": licenses.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
}


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
