"""Decorator that collects the registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridcast.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, check: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under ``key``; ``check`` is the SQL with the same result, behind ``views``."""

    def add(f: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = f
        if check is not None:
            ORACLES[key] = V.sql(check, *views)
        return f

    return add
