"""Every registered query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is only checked for its rows here and against brute force in the tests."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add
