"""All queries of the core, by name, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from darkroom.plans import archive_queries, match_queries, review_queries, state_queries, status_queries

_MODULES: list = [archive_queries, match_queries, review_queries, state_queries, status_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.oracle_sql().items()}
