"""Registry of checkable queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with its SQL equivalent."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def with_sql(ctes: list[str], select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


_SHARED: dict = {}


def shared(spark: SparkSession, sf: str, name: str, build):
    """Build a plan once per session and folder; queries over the same study share it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def forget_shared() -> None:
    """Let the next query build its plans anew."""
    _SHARED.clear()
