"""Names queries and keeps their callables and SQL together."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries by name, with the SQL that DuckDB runs for the same result, where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Callable], Callable]:
        def keep(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep
