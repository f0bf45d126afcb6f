"""Registry of the queries over the driver's tables: a Spark plan and its DuckDB equivalent under one name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """A registered query: how Spark runs it, what DuckDB must agree with, and the survey rows it covers."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


QUERIES: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None):
    """Decorator: enter a (spark, sf_dir) -> DataFrame function under `name`."""

    def enter(run):
        QUERIES[name] = Query(run, sql, ops)
        return run

    return enter


from . import feature_queries, split_queries, stream_queries, study_queries, sweep_queries, table_queries, verification_queries, version_queries  # noqa: E402,F401  the modules enter their queries above
