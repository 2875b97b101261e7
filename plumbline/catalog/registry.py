"""Registry of named queries, each with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.tables import KEY_SPLIT_SQL, SALES_SQL, TIME_SPLIT_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def on_sales(body: str, ctes: str = "", split: str = KEY_SPLIT_SQL) -> str:
    """Check SQL over the ``sales`` table and any further named subqueries."""
    extra = f",\n{ctes}" if ctes else ""
    return f"WITH {SALES_SQL.format(split=split)}{extra}\n{body}"


def on_time_split_sales(body: str, ctes: str = "") -> str:
    return on_sales(body, ctes, TIME_SPLIT_SQL)
