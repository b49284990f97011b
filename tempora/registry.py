"""Where queries and their oracles meet: `@query(sql)` registers a function of (spark, sf_dir) under its name."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query; sql is DuckDB SQL for the same rows and column names."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
