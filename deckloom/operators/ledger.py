"""Execution ledgers: steps with their calls, folding of like calls, tools and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger_steps(entries: DataFrame) -> DataFrame:
    """LED-1: ``project_id, seq, name, duration_s, calls, call_seconds`` of each step; only steps count in total time."""
    calls = entries.filter("kind = 'call'").groupBy("project_id", F.col("parent").alias("seq"))
    calls = calls.agg(F.count("*").alias("calls"), F.round(F.sum("duration_s"), 2).alias("call_seconds"))
    steps = entries.filter("kind <> 'call'").select("project_id", "seq", "name", "duration_s")
    return steps.join(calls, ["project_id", "seq"], "left").fillna({"calls": 0, "call_seconds": 0.0})


def fold_calls(entries: DataFrame) -> DataFrame:
    """LED-2: consecutive calls of one step with the same name and coverage become one row with their number and time."""
    order = Window.partitionBy("project_id", "parent").orderBy("seq")
    calls = entries.filter("kind = 'call'").withColumn("__c", F.array_join("covers", "|"))
    same = (F.col("name") == F.lag("name").over(order)) & (F.col("__c") == F.lag("__c").over(order)) & (F.col("__c") != "")
    calls = calls.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(order))
    folded = calls.groupBy("project_id", "parent", "__run").agg(
        F.min("seq").alias("seq"),
        F.first("name").alias("name"),
        F.count("*").alias("parts"),
        F.round(F.sum("duration_s"), 2).alias("duration_s"),
        F.max((F.col("status") == "failed").cast("int")).cast("boolean").alias("failed"),
    )
    return folded.drop("__run")


def step_tools(entries: DataFrame) -> DataFrame:
    """LED-4: the distinct tools of each step's calls, in the order they were first used."""
    first = entries.filter("kind = 'call'").groupBy("project_id", "parent", "name").agg(F.min("seq").alias("__s"))
    pairs = F.array_sort(F.collect_list(F.struct("__s", "name")))
    return first.groupBy("project_id", "parent").agg(F.transform(pairs, lambda x: x["name"]).alias("tools"))


def merge_covers(entries: DataFrame) -> DataFrame:
    """LED-5: a call's coverage is its step's, then its own, without repeats."""
    outer = entries.filter("kind <> 'call'").select("project_id", F.col("seq").alias("parent"), F.col("covers").alias("__outer"))
    calls = entries.filter("kind = 'call'").join(outer, ["project_id", "parent"], "left")
    covers = F.array_distinct(F.concat(F.coalesce("__outer", F.array().cast("array<string>")), "covers"))
    return calls.select("project_id", "seq", covers.alias("covers"))


def ledger_by_run(entries: DataFrame) -> DataFrame:
    """LED-6: ``run_id, entries, failed, seconds`` with times of steps only."""
    seconds = F.sum(F.when(F.col("kind") != "call", F.col("duration_s")))
    return entries.groupBy("run_id").agg(
        F.count("*").alias("entries"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"), F.round(seconds, 2).alias("seconds")
    )


def pair_artifacts(entries: DataFrame) -> DataFrame:
    """LED-3: ``project_id, parent, index, claimed_by``: a step's artifacts, each with the first call under it that covers
    its scene or page; null if none does. ``artifacts`` are structs with ``scene_id`` and ``page``."""
    made = entries.filter("kind <> 'call'").select("project_id", F.col("seq").alias("parent"), F.posexplode("artifacts").alias("index", "__a"))
    named = F.array_compact(F.array(F.concat(F.lit("scene:"), F.nullif("__a.scene_id", F.lit(""))), F.concat(F.lit("page:"), F.col("__a.page").cast("string"))))
    keys = made.select("project_id", "parent", "index", F.explode(named).alias("key"))
    calls = entries.filter("kind = 'call'").select("project_id", "parent", "seq", F.explode("covers").alias("key"))
    first = calls.groupBy("project_id", "parent", "key").agg(F.min("seq").alias("seq"))
    won = keys.join(first, ["project_id", "parent", "key"]).groupBy("project_id", "parent", "index").agg(F.min("seq").alias("claimed_by"))
    return made.drop("__a").join(won, ["project_id", "parent", "index"], "left")


def stage_artifacts(tables: dict[str, DataFrame], stage: str) -> DataFrame:
    """LED-7: ``project_id, index, label, kind, path, text, scene_id, page``: what a stage made, in order from 0.

    ``tables`` are those of the project that the stage reads: ``pages`` (parse, understand), ``scenes`` (narrate, voice,
    direct, render), ``actions`` (direct), ``projects`` with ``speech_rate`` (voice) and ``output_path`` (render),
    ``timeline`` with ``clips, cues, duration`` (motion), ``clips`` with ``scene_id, path`` (render), ``quality`` and
    ``findings`` with their place ``finding_no`` (review). A stage of another name made nothing.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    nothing = F.lit("")

    def made(rows: DataFrame, place: Column, label: Column, kind: str, path=nothing, text=nothing, scene=nothing, page=None) -> DataFrame:
        order = Window.partitionBy("project_id").orderBy(place)
        index = (F.row_number().over(order) - 1).alias("index")
        return rows.select("project_id", index, label.alias("label"), F.lit(kind).alias("kind"), path.alias("path"), text.alias("text"), scene.alias("scene_id"), (F.lit(None) if page is None else page).cast("int").alias("page"))

    def after(first: DataFrame, then: DataFrame) -> DataFrame:
        """The second rows' places go on from the number of the first."""
        counts = first.groupBy("project_id").agg(F.count("*").cast("int").alias("__n"))
        moved = then.join(counts, "project_id", "left").withColumn("index", F.col("index") + F.coalesce("__n", F.lit(0)))
        return first.unionByName(moved.drop("__n"))

    at, of = F.col("page_index"), F.col("source_page")
    if stage == "parse":
        return made(tables["pages"].filter(blank(F.col("image_path")) != ""), at, F.format_string("第 %d 页", at), "image", path=F.col("image_path"), page=at)
    if stage == "understand":
        told = F.coalesce(F.nullif("summary", nothing), F.lit("（无摘要）"))
        return made(tables["pages"], at, F.format_string("第 %d 页｜%s", at, F.col("page_type")), "text", text=told, page=at)
    if stage == "motion":
        counts = F.format_string("%d 段画面、%d 条字幕、共 %.1f 秒", "clips", "cues", "duration")
        return made(tables["timeline"], F.col("project_id"), F.lit("时间轴"), "text", text=counts)
    if stage == "review":
        line = F.format_string("[%s] %s：%s", "severity", F.coalesce(F.nullif("scene_id", nothing), F.lit("整体")), "message")
        lines = F.transform(F.array_sort(F.collect_list(F.struct("finding_no", line.alias("l")))), lambda x: x["l"])
        said = tables["findings"].groupBy("project_id").agg(F.array_join(lines, "\n").alias("__said"))
        rows = tables["projects"].select("project_id").join(tables["quality"].select("project_id", "score"), "project_id", "left").join(said, "project_id", "left")
        label = F.when(F.col("score").isNull(), "质检").otherwise(F.concat(F.lit("质量分 "), F.col("score").cast("string")))
        return made(rows, F.col("project_id"), label, "text", text=F.coalesce("__said", F.lit("没有发现问题")))
    if stage not in ("narrate", "voice", "direct", "render"):
        return made(tables["projects"].filter("false"), F.col("project_id"), nothing, "text")
    scenes, place, scene = tables["scenes"], F.col("scene_seq"), F.col("scene_id")
    if stage == "narrate":
        return made(scenes, place, F.format_string("第 %d 页讲稿", of), "text", text=blank(F.col("narration")), scene=scene, page=of)
    if stage == "direct":
        move = F.concat(F.format_string("%s @%.1fs", "type", "at"), F.when(blank(F.col("target")) != "", F.concat(F.lit(" → "), "target")).otherwise(nothing))
        moves = F.transform(F.array_sort(F.collect_list(F.struct("action_seq", move.alias("m")))), lambda x: x["m"])
        shown = tables["actions"].groupBy("project_id", "scene_id").agg(F.array_join(moves, "；").alias("__moves"))
        text = F.coalesce("__moves", F.lit("（这一页没有镜头动作）"))
        return made(scenes.join(shown, ["project_id", "scene_id"], "left"), place, F.format_string("第 %d 页镜头", of), "text", text=text, scene=scene, page=of)
    if stage == "voice":
        heard = scenes.filter(blank(F.col("audio_path")) != "")
        first = heard.groupBy("project_id").agg(F.min_by(F.struct("provider", "voice"), "scene_seq").alias("__by"))
        rate = F.when(F.coalesce("speech_rate", F.lit(0.0)) != 0, F.format_string("｜语速 %.2f×", "speech_rate")).otherwise("｜引擎自己的语速")
        said = F.concat(blank(F.col("__by.provider")), F.lit("｜"), F.coalesce(F.nullif("__by.voice", nothing), F.lit("引擎默认音色")), rate)
        voice = made(first.join(tables["projects"].select("project_id", "speech_rate"), "project_id", "left"), F.col("project_id"), F.lit("用的声音"), "text", text=said)
        sound = made(heard, place, F.format_string("第 %d 页配音（%.1fs）", of, "duration"), "audio", path=F.col("audio_path"), scene=scene, page=of)
        return after(voice, sound)
    clips = tables["clips"].filter(blank(F.col("path")) != "").select("project_id", "scene_id", F.col("path").alias("__clip"))
    parts = made(scenes.join(clips, ["project_id", "scene_id"]), place, F.format_string("第 %d 页片段", of), "video", path=F.col("__clip"), scene=scene, page=of)
    whole = made(tables["projects"].filter(blank(F.col("output_path")) != ""), F.col("project_id"), F.lit("成片"), "video", path=F.col("output_path"))
    return after(parts, whole)
