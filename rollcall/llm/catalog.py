"""Query names of this subpackage, their callables and their SQL."""

from __future__ import annotations

from rollcall.llm import problems


def queries() -> dict:
    return dict(problems.QUERIES)


def oracle_sql() -> dict[str, str]:
    return {}
