"""All queries of the core with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import catalog_queries, evaluation_queries, manifest_queries, profile_queries, selection_queries

MODULES = (profile_queries, catalog_queries, manifest_queries, selection_queries, evaluation_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
