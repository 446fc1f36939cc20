"""All queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import criterion_queries, family_queries, graph_queries, model_queries, space_queries, statistics_queries, validity_queries

Query = Callable[[SparkSession, str], DataFrame]
PLANS = (graph_queries, criterion_queries, space_queries, model_queries, statistics_queries, validity_queries, family_queries)


def queries() -> dict[str, Query]:
    return {name: f for plan in PLANS for name, f in plan.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.oracle_sql().items()}
