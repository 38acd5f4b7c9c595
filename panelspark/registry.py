"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with the oracle SQL.

Every query reads the driver's tables (or views Spark derives from them), so
its work grows with the data. Queries without oracle SQL (``sql=None``) are
checked rows-only by the driver and by unit tests against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from panelspark import queries_core  # noqa: F401
    from panelspark import queries_ops  # noqa: F401
    from panelspark import queries_ml  # noqa: F401
