"""All registered queries and their oracles."""

from __future__ import annotations

from palisade.plans import estate_queries, market_queries, tree_queries

MODULES = [market_queries, estate_queries, tree_queries]


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
