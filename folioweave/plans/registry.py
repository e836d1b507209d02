"""Catalogue of runnable queries and their equivalent ANSI SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioweave.session import workers_find_package

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def prepared(fn: QueryFn) -> QueryFn:
    """The query, run in a session whose workers can import this package."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_find_package(spark)
        return fn(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under ``name`` together with its check SQL."""

    def register(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = prepared(fn)
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn

    return register


def all_queries() -> dict[str, QueryFn]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)
