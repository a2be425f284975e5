"""Queries by name, with the SURVEY operators they run and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(name: str, operators: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name], OPERATORS[name] = f, operators
        if sql:
            SQL[name] = sql
        return f

    return put
