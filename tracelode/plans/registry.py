"""Named queries with, where plain SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelode.sources.views import Tables, check_sql, input_version

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
_tables: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, folder: str) -> Tables:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _tables or _tables[key].version != input_version(spark, folder):
        _tables[key] = Tables(spark, folder)
    return _tables[key]


def query(name: str, check: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register `f(tables)` under `name`; `check` is the equivalent SQL."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(tables(spark, folder))
        if check is not None:
            CHECKS[name] = check_sql(check)
        return f

    return register
