"""Registry of the queries: each plan module adds its own, with the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "hybrid_search"
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name."""

    def add(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    from . import plans  # noqa: F401  registers on import


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _sql
