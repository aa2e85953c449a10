"""All registered queries of the core and their oracles."""

from __future__ import annotations

from . import answers, extras, grading, io, layout, metrics, pairs, records, tensors, tokens

_PARTS = (pairs, metrics, grading, answers, layout, tokens, tensors, records, extras, io)


def queries() -> dict:
    return {k: f for part in _PARTS for k, f in part.C.runs.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in _PARTS for k, q in part.C.sql.items()}
