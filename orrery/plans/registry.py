"""The queries of the graph engine: a Spark plan and, where SQL can say it, SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Register a plan over Tables under its function's name.

    ``sql`` is a SELECT, or further common tables followed by one, after the views.
    """

    def add(plan: Callable[[Tables], DataFrame]):
        name = plan.__name__
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql is not None:
            body = sql.strip()
            ORACLE_SQL[name] = f"{VIEWS}{', ' if body.startswith('&') else ''}{body.removeprefix('&')}" if views else body
        return plan

    return add
