"""Registry of the core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..streaming import activity, lifecycle
from . import corpus_queries, file_queries, project_queries, search_queries, symbol_queries, timeline_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (search_queries, timeline_queries, file_queries, corpus_queries, project_queries, symbol_queries, activity, lifecycle)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
