"""Named queries over the test tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULE_OF: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views=()):
    """Register ``fn(tables) -> DataFrame``; ``views`` are the views the SQL uses."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        MODULE_OF[name] = fn.__module__
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(oracle, views)
        return fn

    return register
