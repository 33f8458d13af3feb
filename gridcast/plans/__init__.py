"""Registered queries over the given tables and the SQL that checks them."""

from gridcast.plans import ingest_queries, model_queries, table_queries  # noqa: F401
from gridcast.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
