"""Registered queries and their counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
COUNTERPARTS: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under a name, its own by default, with the SQL that must give the same rows."""

    def add(query: Query) -> Query:
        key = name or query.__name__
        assert key not in QUERIES, key
        QUERIES[key] = query
        if sql is not None:
            COUNTERPARTS[key] = sql
        return query

    return add
