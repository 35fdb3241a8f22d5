"""Collects the queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.bindings import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``sql`` may use the binding views listed in ``views``."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn
    return add
