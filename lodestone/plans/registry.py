"""All named queries of the engine, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
#: Operators of the inventory that a query exercises.
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name], COVERS[name] = fn, covers
        if sql:
            ORACLES[name] = sql
        return fn

    return add


from . import crawl, external, flows, graph, indexes, knowledge, relational, retrieval, sqlsurface, streams, text, trace, versions  # noqa: E402, F401
