"""All queries over the benchmark tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive_queries, catalog_queries, delta_queries, source_queries, store_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return archive_queries.QUERIES | store_queries.QUERIES | catalog_queries.QUERIES | delta_queries.QUERIES | source_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return archive_queries.SQL | store_queries.SQL | catalog_queries.SQL | delta_queries.SQL | source_queries.SQL
