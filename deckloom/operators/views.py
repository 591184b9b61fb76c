"""Listings of projects, pages and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hay(fields: list[str]) -> Column:
    """The fields in lower case, a line each."""
    return F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]))


def matches(query: str, fields: list[str]) -> Column:
    """Every word of the query stands in one of the fields, whatever its case."""
    found = F.lit(True)
    for word in query.lower().split():
        found = found & F.contains(hay(fields), F.lit(word))
    return found


def catalog_search(catalog: DataFrame, query: str, fields: list[str], key: str, limit: int = 20) -> DataFrame:
    """VW-7: the first entries that match, installed ones first, then by key, with the numbers ``matched`` and ``total``."""
    hit = matches(query, fields)
    counts = catalog.agg(F.count("*").alias("total"), F.count(F.when(hit, 1)).alias("matched"))
    rows = catalog.filter(hit).orderBy(F.desc("installed"), key).limit(limit)
    return rows.join(F.broadcast(counts))


def faceted_search(catalog: DataFrame, query: str, fields: list[str], facet: str) -> DataFrame:
    """VW-9: matching entries by facet, counted before any choice of one."""
    return catalog.filter(matches(query, fields)).groupBy(facet).agg(F.count("*").alias("n"))


def faceted_entries(catalog: DataFrame, query: str, fields: list[str], facet: str, kind: str | None = None) -> DataFrame:
    """VW-9: the matching entries of one facet, of all if ``kind`` is None; the facets' counts don't change with the choice."""
    found = catalog.filter(matches(query, fields))
    return found if kind is None else found.filter(F.col(facet) == kind)


def page_views(pages: DataFrame, scenes: DataFrame) -> DataFrame:
    """VW-3: pages with the script that they have, if any."""
    told = scenes.select("project_id", F.col("source_page").alias("page_index"), "scene_id", "narration")
    return pages.join(told, ["project_id", "page_index"], "left").select("project_id", "page_index", "title", "page_type", "scene_id", F.coalesce("narration", F.lit("")).alias("narration"))


def project_summary(scenes: DataFrame, scores: DataFrame) -> DataFrame:
    """VW-1: ``project_id, scenes, duration, ready, score`` of each project; ready if every scene has a recording."""
    made = scenes.groupBy("project_id").agg(
        F.count("*").alias("scenes"), F.round(F.sum("duration"), 1).alias("duration"), F.bool_and(F.col("audio_path").isNotNull()).alias("ready")
    )
    return made.join(scores.select("project_id", "score"), "project_id", "left")


def project_details(projects: DataFrame, scenes: DataFrame, findings: DataFrame, scores: DataFrame) -> DataFrame:
    """VW-1, in full: a project's ``status, file, title``, length and ``target`` in seconds, ``scene_count``, ``output_ready``,
    ``quality``, ``review`` (its findings) and ``scenes`` in order. Without scenes or findings the lists are empty.

    ``projects`` have ``status, file, title, target, output_path``.
    """
    shown = F.struct("scene_seq", "scene_id", "source_page", F.round("duration", 1).alias("duration_s"), "narration")
    told = F.struct("kind", F.coalesce("scene_id", F.lit("")).alias("scene_id"), "severity", "message")
    made = scenes.groupBy("project_id").agg(F.round(F.sum("duration"), 1).alias("duration_s"), F.count("*").alias("scene_count"), F.array_sort(F.collect_list(shown)).alias("scenes"))
    said = findings.groupBy("project_id").agg(F.array_sort(F.collect_list(told)).alias("review"))
    rows = projects.join(made, "project_id", "left").join(said, "project_id", "left").join(scores.select("project_id", F.col("score").alias("quality")), "project_id", "left")
    none = lambda c, like: F.coalesce(c, F.array().cast(like.schema[c].dataType))
    return rows.select(
        "project_id", "status", "file", "title", F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"), "target", F.coalesce("scene_count", F.lit(0)).alias("scene_count"),
        (F.coalesce("output_path", F.lit("")) != "").alias("output_ready"), "quality", none("review", said).alias("review"), none("scenes", made).alias("scenes"),
    )


def document_view(pages: DataFrame, elements: DataFrame, guide: DataFrame) -> DataFrame:
    """VW-2: pages with the elements that have text, in order, and the budget to write their script by."""
    page = ["project_id", "page_index"]
    told = elements.filter(F.coalesce("text", F.lit("")) != "")
    parts = F.array_sort(F.collect_list(F.struct("seq", "element_id", "kind", "text")))
    rows = pages.select(*page, "title", "page_type").join(told.groupBy(*page).agg(parts.alias("elements")), page, "left")
    none = F.array().cast("array<struct<seq:int,element_id:string,kind:string,text:string>>")
    return rows.withColumn("elements", F.coalesce("elements", none)).join(guide.select(*page, "target_seconds", "chars"), page, "left")


def scene_list(scenes: DataFrame, clips: DataFrame) -> DataFrame:
    """VW-4: scenes with the path of their own clip, if it was made; ``clips`` hold one map for each project."""
    rows = scenes.join(clips.select("project_id", "scene_clips"), "project_id", "left")
    return rows.withColumn("clip", F.try_element_at("scene_clips", F.col("scene_id"))).drop("scene_clips")


def run_result(runs: DataFrame, scenes: DataFrame) -> DataFrame:
    """VW-5: each run's status, the names of its stages in order, and its project's scenes and length."""
    made = scenes.groupBy("project_id").agg(F.count("*").alias("scene_count"), F.round(F.sum("duration"), 1).alias("duration"))
    rows = runs.select("project_id", "run_id", "status", F.transform("stages", lambda s: s["stage"]).alias("stages"), F.col("quality.score").alias("quality"))
    return rows.join(made, "project_id", "left").fillna({"scene_count": 0})


def project_overview(scenes: DataFrame, actions: DataFrame, decks: DataFrame) -> DataFrame:
    """VW-6: ``project_id, overview``: one text for each of ``decks``: what it is, how long, how good, how its last run went, a
    line for each scene with its page, seconds and moves at targets and the beginning of its script, and the findings.

    ``decks`` have ``status, file, title, topic, target, output_path, score, dimensions`` (``name, score``), ``run_s, degraded`` and
    ``findings`` (``severity, scene_id, message``, in order). Without a score, a run, scenes or findings their lines are missing.
    """
    aimed = actions.filter("target <> ''")
    moves = F.array_sort(F.collect_list(F.struct("at", F.format_string("%s@%.1fs", "type", "at").alias("t"))))
    said = aimed.groupBy("project_id", "scene_id").agg(F.array_join(F.transform(moves, lambda m: m["t"]), "、").alias("__m"))
    rows = scenes.join(said, ["project_id", "scene_id"], "left")
    line = F.format_string("  %s  p%-3d %6.1fs  动作：%s\n      %s", "scene_id", "source_page", "duration", F.coalesce("__m", F.lit("无")), F.substring("narration", 1, 60))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("scene_seq", line.alias("l")))), lambda x: x["l"])
    told = rows.groupBy("project_id").agg(F.array_join(lines, "\n").alias("__scenes"), F.sum("duration").alias("__s"))
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    dimensions = F.array_join(F.transform("dimensions", lambda d: F.format_string("%s %.0f", d["name"], d["score"])), "｜")
    found = F.transform("findings", lambda f: F.format_string("  [%s] %s %s", f["severity"], F.coalesce(F.nullif(f["scene_id"], F.lit("")), F.lit("-")), or_empty(f["message"])))
    text = F.concat_ws(
        "\n",
        F.format_string("工程 %s｜状态 %s｜来源 %s", "project_id", or_empty(F.col("status")), or_empty(F.col("file"))),
        F.format_string("标题：%s｜主题：%s", or_empty(F.col("title")), or_empty(F.col("topic"))),
        F.format_string("时长：%.1f 秒（目标 %d 秒）", F.coalesce("__s", F.lit(0.0)), "target"),
        F.concat(F.lit("成片："), F.coalesce(F.nullif("output_path", F.lit("")), F.lit("（未生成）"))),
        F.when(F.col("score").isNotNull(), F.format_string("质量：%.1f 分（%s）", "score", dimensions)),
        F.when(F.col("run_s").isNotNull(), F.format_string("上次运行：%.0f 秒｜降级 %d 处", "run_s", "degraded")),
        F.concat(F.lit("\n场景：\n"), "__scenes"),
        F.when(F.size("findings") > 0, F.concat(F.lit("\n质检：\n"), F.array_join(found, "\n"))),
    )
    return decks.join(told, "project_id", "left").select("project_id", text.alias("overview"))
