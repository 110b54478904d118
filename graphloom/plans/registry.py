"""All queries of the core, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import evaluation_queries, graph_queries, ingest_queries, preparation

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [preparation, graph_queries, ingest_queries, evaluation_queries]


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}
