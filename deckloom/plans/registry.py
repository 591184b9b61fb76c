"""Every query of the library and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deckloom.plans import attention_queries, caption_queries, chart_queries, doc_queries, draft_queries, live_queries, message_queries, narration_queries
from deckloom.plans import review_queries, run_queries, shot_queries, source_queries, view_queries

AREAS = (run_queries, doc_queries, narration_queries, review_queries, live_queries, attention_queries, caption_queries, shot_queries, message_queries, chart_queries, view_queries, draft_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for area in AREAS for name, query in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.SQL.items()}
