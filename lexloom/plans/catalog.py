"""All core queries and their oracle SQL, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans import retrieval_queries, store_queries, stream_queries, tagging_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES: list = [text_queries, retrieval_queries, tagging_queries, store_queries, stream_queries]


def queries() -> dict[str, Query]:
    """Query name to a function of (spark, sf_dir)."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
