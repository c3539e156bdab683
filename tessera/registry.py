"""Where modules of plans register their queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def graph_sql(body: str) -> str:
    """body after the common table expressions of the graph view; it may go on with further ones if it begins with a comma."""
    from tessera.testgraph import SQL as view

    return f"WITH RECURSIVE {view}{body}"
