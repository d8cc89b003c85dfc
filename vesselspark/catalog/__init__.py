"""Registered queries: name -> (Spark callable, SQL text for the reference engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import get, table, with_views
from ..session import sized_by_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: list[str], sql: str | None = None):
    """Register ``fn(*inputs)``; inputs are the named views (or plain tables)."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            sized_by_rows(spark)
            inputs = [get(spark, sf_dir, v) if v.startswith("fx_") else table(spark, sf_dir, v) for v in views]
            return fn(*inputs)

        run.__name__ = name
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views([v for v in views if v.startswith("fx_")], sql)
        return fn

    return register


def load() -> None:
    from . import cohort, evaluation, features, formats, graphs, labelling, matching, points, volumes, windows  # noqa: F401
