"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.plans import document_queries, draft_queries, event_queries, layout_queries, nested_queries, retrieval_queries, review_queries, stream_queries, upkeep_queries, validation_queries

_MODULES = [retrieval_queries, event_queries, layout_queries, document_queries, draft_queries, review_queries, nested_queries, stream_queries, validation_queries, upkeep_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.ORACLES.items()}
