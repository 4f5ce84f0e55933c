"""All registered queries and their DuckDB oracle SQL."""

from __future__ import annotations

from . import apps, keyed, pages, streams, tasks, text

_MODULES = [keyed, text, tasks, apps, pages, streams]


def queries():
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
