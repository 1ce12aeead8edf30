"""Registering a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from resona.sources.fixtures import sql_over, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str, sql: str | None = None):
    """Decorate f(*views) -> DataFrame: its name becomes the query's, ``sql`` (over the same views) its oracle."""
    names = tuple(views.split())

    def register(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(view(spark, sf_dir, n) for n in names))
        if sql is not None:
            from resona.sources.fixtures import VIEWS

            used = tuple(n for n in names if n in VIEWS)
            ORACLES[f.__name__] = sql_over(used, sql) if used else sql
        return f

    return register
