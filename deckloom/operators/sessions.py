"""Conversations: cost, recent turns, and compaction of long sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPACT_ABOVE, KEEP_RECENT = 6000, 8
DIGEST_ASKS, DIGEST_CHARS = 6, 60


def turn_cost() -> Column:
    """SES-1: half the characters of text and action, 1 at least."""
    half = lambda c: F.floor(F.length(F.coalesce(F.col(c), F.lit(""))) / 2)
    return F.greatest(F.lit(1), half("text") + half("action")).cast("long")


def session_cost(turns: DataFrame) -> DataFrame:
    """SES-1: ``project_id, turns, cost``."""
    return turns.groupBy("project_id").agg(F.count("*").alias("turns"), F.sum(turn_cost()).alias("cost"))


def recent_turns(turns: DataFrame, n: int = KEEP_RECENT) -> DataFrame:
    """SES-2: the last n turns of each session."""
    newest = Window.partitionBy("project_id").orderBy(F.desc("turn_no"))
    return turns.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= n).drop("__r")


def digest(turns: DataFrame) -> DataFrame:
    """SES-4: ``project_id, folded, asks``: the number of turns, and the first six user texts cut to 60 characters."""
    first = F.array_sort(F.collect_list(F.when(F.col("speaker") == "user", F.struct("turn_no", F.substring("text", 1, DIGEST_CHARS).alias("t")))))
    asks = F.array_join(F.transform(F.slice(first, 1, DIGEST_ASKS), lambda x: x["t"]), "；")
    return turns.groupBy("project_id").agg(F.count("*").alias("folded"), asks.alias("asks"))


def compact(turns: DataFrame, above: int = COMPACT_ABOVE, keep: int = KEEP_RECENT) -> DataFrame:
    """SES-3: ``project_id, turn_no, speaker, text, action``; turns before the last ``keep`` of a session that costs more
    than ``above`` become one summary, numbered 0."""
    cost, n = session_cost(turns), F.col("turns")
    folding = cost.filter((F.col("cost") > above) & (n > keep)).select("project_id", F.col("turns").alias("__n"))
    newest = Window.partitionBy("project_id").orderBy(F.desc("turn_no"))
    ranked = turns.join(folding, "project_id", "left").withColumn("__r", F.row_number().over(newest))
    old = F.col("__n").isNotNull() & (F.col("__r") > keep)
    columns = ["project_id", "turn_no", "speaker", "text", "action"]
    note = F.format_string("（早先的 %d 轮已折叠）用户先后提过：%s", "folded", F.when(F.col("asks") == "", "（没有明确要求）").otherwise(F.col("asks")))
    summary = digest(ranked.filter(old)).select(
        "project_id",
        F.lit(0).cast("int").alias("turn_no"),
        F.lit("summary").alias("speaker"),
        note.alias("text"),
        F.format_string("compacted:%d", "folded").alias("action"),
    )
    return ranked.filter(~old).select(*columns).unionByName(summary)
