"""The registry of runnable queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoline.standins import StandIns, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(stand_ins) -> DataFrame``, with SQL over the named views if it has one."""

    def wrap(fn: Callable[[StandIns], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(StandIns(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return fn

    return wrap


def values(xs, alias: str = "thr") -> str:
    """A one-column inline table of doubles."""
    return "(VALUES " + ", ".join(f"({x!r}::DOUBLE)" for x in xs) + f") AS x({alias})"
