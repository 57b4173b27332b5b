"""Registry of named queries over the driver's tables, with their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its oracle."""

    def add(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLE_SQL[build.__name__] = sql
        return build

    return add
