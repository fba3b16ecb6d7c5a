"""Names, Spark queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_SQL: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(name: str, *views: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL over the named views that gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = (sql, views)
        return fn

    return add


def r6(col: str | Column, name: str | None = None) -> Column:
    """Rounded to six places, as the SQL side is."""
    column = F.col(col) if isinstance(col, str) else col
    return F.round(column, 6).alias(name or col)


def oracles() -> dict[str, str]:
    """The SQL of all queries that have one."""
    return {name: with_views(sql, *views) if views else sql for name, (sql, views) in _SQL.items()}
