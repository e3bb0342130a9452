"""Registered queries: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..adapters import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Views under its own name, with the equal SQL."""
    def register(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Views(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
