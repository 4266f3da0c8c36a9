"""Where queries and their SQL are put under a name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of a ``Tables`` as a query, with the SQL it is held against."""

    def put(f):
        own = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from lociform.plans.bindings import Tables

            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = own, f.__doc__
        QUERIES[own] = run
        if sql:
            SQL[own] = sql
        return f

    return put
