"""Registers of queries."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """queries, oracles, and a decorator that enters a query under its function's name with its SQL, if any."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def enter(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return enter

    return queries, oracles, query
