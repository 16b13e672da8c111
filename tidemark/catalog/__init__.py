"""Registered queries over the given tables, each with the SQL it must agree with.

A query is a function of ``(spark, sf_dir)``. Where SQL can express it, the same rows are
stated as SQL over the tables' names, for an independent engine to compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a unique name."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def load() -> None:
    """Import the modules that register queries."""
    from tidemark.catalog import events, model, quality, relational, stages, streams, tables  # noqa: F401
