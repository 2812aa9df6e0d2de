"""Queries by name, with the fixtures they read and their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempora.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(*names: str, sql: str | None = None):
    """Register a function of the named fixtures' DataFrames."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[fixtures.load(spark, sf_dir, n) for n in names])
        if sql:
            ORACLE[f.__name__] = fixtures.with_duck(names, sql)
        return f

    return add
