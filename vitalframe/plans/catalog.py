"""Registry of the named queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("segment_queries", "aggregate_queries", "join_queries", "stats_queries", "signal_queries", "model_queries", "linear_queries")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Add a query; sql is its oracle, where SQL can express it."""
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = fn
    if sql is not None:
        _ORACLES[name] = sql


def _load() -> None:
    """Import the query modules; each registers its queries once."""
    for name in MODULES:
        import_module(f"vitalframe.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
