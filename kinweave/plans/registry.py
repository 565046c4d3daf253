"""All registered queries and their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave.plans import graph_queries, quality_queries, record_queries, text_queries

MODULES = [graph_queries, record_queries, quality_queries, text_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def checks() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
