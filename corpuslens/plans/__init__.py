"""Registered queries: one per operator, with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from . import coding, corpus, identity, linking, passages, quotes, reports, streams, tables, writing

AREAS = (identity, quotes, coding, tables, corpus, reports, linking, passages, writing, streams)


def queries() -> dict:
    return {name: q for area in AREAS for name, q in area.R.queries.items()}


def oracle_sql() -> dict:
    return {name: q for area in AREAS for name, q in area.R.sql.items()}
