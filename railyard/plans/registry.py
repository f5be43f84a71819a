"""Registry of named queries (Spark callables) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from railyard.plans.oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, extra_views: dict[str, str] | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional oracle."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, extra_views)
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that their ``register`` calls run."""
    from railyard.plans import (  # noqa: F401
        q_integrity,
        q_scalars,
        q_ordered,
        q_validate,
        q_store,
        q_quality,
        q_features,
        q_mapping,
        q_service,
        q_netex,
        q_netex_xml,
        q_sources,
    )
