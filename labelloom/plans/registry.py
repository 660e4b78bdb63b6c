"""Named queries over the test tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelloom.sources.adapter import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with optional SQL for the second engine."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    """Import every module that registers queries."""
    from labelloom.plans import scoring, fusion, geometry, validation, rewards, preparation, evaluation, state  # noqa: F401,I001
