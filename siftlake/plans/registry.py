"""Collects the queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlake.plans import increment_queries, search_queries, usage_queries

_MODULES = [increment_queries, search_queries, usage_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.hybrid_reranked(spark, sf_dir)
