"""A decorator that collects queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def collector() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict = {}

    def query(name: str, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            queries[name] = f
            if sql is not None:
                oracles[name] = sql
            return f

        return keep

    return queries, oracles, query
