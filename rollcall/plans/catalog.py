"""Query names of the core, their callables and their SQL."""

from __future__ import annotations

from rollcall.plans import geo, identity, picks, problem_sql, problems, relational, scalars, sources

_PARTS = (scalars, relational, identity, geo, picks, sources)


def queries() -> dict:
    out = {}
    for part in _PARTS:
        out |= part.R.queries
    return out | problems.QUERIES


def oracle_sql() -> dict[str, str]:
    out = {}
    for part in _PARTS:
        out |= part.R.sql
    return out | problem_sql.SQL
