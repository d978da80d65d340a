"""Every registered query of the engine's own operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.plans import chain_queries, graph_queries, kernel_queries, layout_queries, overlap_queries, read_queries, record_queries, statistic_queries

MODULES = (read_queries, overlap_queries, statistic_queries, chain_queries, layout_queries, record_queries, graph_queries, kernel_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
