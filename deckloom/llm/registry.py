"""The queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deckloom.llm import (
    convnet,
    filter_audit,
    html_text,
    merkle,
    mixing,
    nearest,
    packing,
    quality,
    simhash,
    substrings,
    token_counts,
    token_files,
    toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.query,
        "op2_nearest": nearest.query,
        "op3_html_text": html_text.query,
        "op4_substring_dedup": substrings.query,
        "op5_toxicity": toxicity.query,
        "op6_token_files": token_files.query,
        "op7_simhash": simhash.query,
        "op8_packing": packing.query,
        "op9_quality": quality.query,
        "op10_token_counts": token_counts.query,
        "op11_quality_net": convnet.query,
        "op12_merkle": merkle.query,
        "op13_filter_audit": filter_audit.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op12_merkle": merkle.SQL, "op13_filter_audit": filter_audit.SQL}
