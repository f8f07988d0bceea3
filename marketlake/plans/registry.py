"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, use: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``use`` names the shared SQL views its twin is built on."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            from marketlake.plans.sqlviews import with_views

            ORACLES[name] = with_views(use, sql)
        return fn

    return add
