"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable


def registry(queries: dict, oracles: dict[str, str]) -> Callable:
    """A decorator that puts a function under its name into queries, and its SQL into oracles."""

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return put

    return query
