"""Queries over the driver's tables, one for each operator, with their DuckDB SQL."""

from __future__ import annotations

from . import q_assemble, q_correct, q_jobs, q_more, q_text, q_translate

FLAGSHIP = "W2_char_spans"
_MODULES = (q_text, q_assemble, q_correct, q_translate, q_jobs, q_more)


def queries() -> dict:
    return {name: fn for m in _MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
