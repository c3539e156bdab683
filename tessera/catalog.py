"""All queries of the library's own operators."""

from __future__ import annotations

from tessera.plans import algorithm_queries, card_queries, event_queries, graph_queries, mining_queries, store_queries, structure_queries  # noqa: F401
from tessera.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
