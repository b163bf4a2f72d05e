"""Named queries of the engine and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import box_queries, layout_queries, page_queries, score_queries, text_queries

FLAGSHIP = "grouped_scores"
_MODULES = (score_queries, text_queries, layout_queries, page_queries, box_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
