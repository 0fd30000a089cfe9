"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where the result is expressible in SQL, the equivalent DuckDB statement over the
same driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from shopflow.plans import recs, metrics, search, quality, store, vectors, textsearch, etl, hybrid, consolidated  # noqa: F401
