"""All queries of the library, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (views) -> DataFrame under a name, with its SQL."""

    def add(f: Callable):
        from .views import Views

        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _load() -> None:
    from . import q_dashboard, q_explorer, q_io, q_ledger, q_match, q_quality, q_search, q_text, q_time  # noqa: F401


_load()
