"""Names of the queries, their functions and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir) under ``name`` with its oracle SQL."""

    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)


def oracle_of(name: str) -> str:
    """The SQL of a query that is already registered."""
    return _SQL[name]


def load() -> None:
    """Import the modules that register queries."""
    from .plans import monitor, profile, quality, retrieval, stats, streams, tables, text  # noqa: F401
