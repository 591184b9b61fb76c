"""Speaking budgets, scripts and their fitting to a length, and timing of what is spoken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.functions.arrays import running
from deckloom.functions.text import bound, stripped
from deckloom.sources.shared import stored
from deckloom.sources.versions import Versions, last_of

PAGE = ["project_id", "page_index"]
# Weight of a page's type in the speaking time.
TYPE_WEIGHTS = {
    "cover": 0.35,
    "agenda": 0.45,
    "section": 0.4,
    "content": 1.0,
    "chart": 1.25,
    "architecture": 1.35,
    "comparison": 1.15,
    "case": 1.15,
    "summary": 0.8,
    "contact": 0.25,
    "other": 0.9,
}
EMPHASIS, LEAST_SECONDS, MOST_SECONDS = 1.9, 4.0, 75.0
PACE, WORDS_PER_SECOND, LEAD, TAIL, TOLERANCE = 4.6, 2.6, 1.1, 1.0, 0.10
#: Marks that end a sentence; ``SENTENCES_LATIN`` adds the full stop.
SENTENCES, SENTENCES_LATIN = "。！？!?；;", "。！？!?；;."
ENDS, ENDS_LATIN = "。！？", "。！？.!?"
CJK = "[一-鿿]"


def allocate_budget(pages: DataFrame, intents: DataFrame, silence: float = LEAD + TAIL) -> DataFrame:
    """NAR-1: ``project_id, page_index, budget``: seconds of speech for each page, by type, text and emphasis.

    Silence around the pages comes off first, but never more than 60 % of the length; shares are clamped afterwards.
    """
    weights = F.create_map(*[F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv])
    rows = pages.join(intents.select("project_id", "duration", "emphasis_pages"), "project_id")
    weight = F.coalesce(F.try_element_at(weights, F.col("page_type")), F.lit(1.0))
    weight = weight * (1.0 + F.least(F.length("raw_text"), F.lit(600)) / 600)
    weight = weight * F.when(F.array_contains("emphasis_pages", F.col("page_index")), EMPHASIS).otherwise(1.0)
    deck = Window.partitionBy("project_id")
    # Weights of 0.25 or more are whole multiples of 2 ** -54, so their sum is exact, whatever the order, and rounded once.
    units = F.sum((F.col("__w") * 2.0**54).cast("long").cast("decimal(20,0)")).over(deck)
    rows = rows.withColumn("__w", weight).withColumns({"__sum": units.cast("double") / 2.0**54, "__n": F.count("*").over(deck)})
    speech = F.greatest(F.col("duration") - silence * F.col("__n"), F.col("duration") * 0.4)
    share = speech * F.col("__w") / F.col("__sum")
    return rows.select(*PAGE, F.greatest(F.lit(LEAST_SECONDS), F.least(F.lit(MOST_SECONDS), share)).alias("budget"))


def tenths(c: Column) -> Column:
    """To 1 decimal, half up, by the same few double operations in any engine; ``round`` goes by the decimal digits."""
    return F.floor(c * 10 + 0.5) / 10.0


def narration_guide(budget: DataFrame, pace: float = PACE, silence: float = LEAD + TAIL) -> DataFrame:
    """NAR-2: ``target_seconds, chars, page_seconds`` to write each page by; seconds to one decimal, half up."""
    return budget.select(
        *PAGE,
        tenths(F.col("budget")).alias("target_seconds"),
        F.floor(F.col("budget") * pace).cast("int").alias("chars"),
        tenths(F.col("budget") + silence).alias("page_seconds"),
    )


def narratable_pages(pages: DataFrame, intents: DataFrame) -> DataFrame:
    """NAR-3: pages that the intent doesn't skip."""
    skip = intents.select("project_id", F.explode("skip_pages").alias("page_index"))
    return pages.join(skip, PAGE, "left_anti")


def estimate_duration(text: Column, rate: float = 1.0, pace: float = PACE) -> Column:
    """NAR-4: seconds to speak a text: CJK characters by pace, other white-space separated words by rate, 0.8 at least."""
    cjk = F.regexp_count(text, F.lit(CJK))
    words = F.regexp_count(F.regexp_replace(text, CJK, " "), F.lit(r"(?U)\S+"))
    return F.greatest(F.lit(0.8), (cjk / pace + words / WORDS_PER_SECOND) / max(rate, 0.1))


def sentences(text: Column, marks: str = SENTENCES) -> Column:
    """The sentences of a text, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, rf"(?<=[{marks}])\s*|\n+"), stripped), lambda x: x != "")


def split_segments(scripts: DataFrame, marks: str = SENTENCES) -> DataFrame:
    """NAR-5: ``project_id, page_index, seg_seq, segment_id, text`` of scripts ``project_id, page_index, narration``."""
    rows = scripts.select(*PAGE, F.posexplode(sentences(F.col("narration"), marks)).alias("i", "text"))
    seq = (F.col("i") + 1).cast("int")
    return rows.select(*PAGE, seq.alias("seg_seq"), F.format_string("scene_%02d_s%02d", "page_index", seq).alias("segment_id"), "text")


def build_scenes(pages: DataFrame, drafts: DataFrame, pace: float = PACE) -> DataFrame:
    """NAR-6: ``project_id, scene_seq, scene_id, source_page, title, narration, duration`` of pages that have a draft; the
    number is the page's place in the list, so gaps stay."""
    return _scenes(_placed(pages).join(drafts.select(*PAGE, "narration"), PAGE), pace)


def build_scenes_of_drafts(pages: DataFrame, pace: float = PACE) -> DataFrame:
    """NAR-6 for pages that hold their draft themselves, as ``narration``: no join, so texts move once."""
    return _scenes(_placed(pages), pace)


def _placed(pages: DataFrame) -> DataFrame:
    return pages.withColumn("scene_seq", F.row_number().over(Window.partitionBy("project_id").orderBy("page_index")))


def _scenes(rows: DataFrame, pace: float) -> DataFrame:
    said = stripped(F.col("narration"))
    return rows.select(
        "project_id", "scene_seq", F.format_string("scene_%02d", "scene_seq").alias("scene_id"), F.col("page_index").alias("source_page"),
        "title", said.alias("narration"), F.round(estimate_duration(said, pace=pace), 3).alias("duration"),
    )


def keep_known_refs(segments: DataFrame, elements: DataFrame) -> DataFrame:
    """NAR-6: drop blank segments, and references to elements that the page doesn't have."""
    known = elements.groupBy(*PAGE).agg(F.collect_set("element_id").alias("__ids"))
    rows = segments.filter(stripped(F.col("text")) != "").join(known, PAGE, "left")
    kept = F.filter("element_refs", lambda x: F.array_contains(F.coalesce("__ids", F.array().cast("array<string>")), x))
    return rows.withColumn("element_refs", kept).drop("__ids")


def adopt_script(pages: DataFrame, scripts: DataFrame, fallback: DataFrame) -> DataFrame:
    """NAR-7: ``narration, missing``: the written text of each page; a blank or missing one is filled from the fallback."""
    text = F.nullif(stripped(F.col("__text")), F.lit(""))
    rows = pages.select(*PAGE).join(scripts.select(*PAGE, F.col("narration").alias("__text")), PAGE, "left")
    rows = rows.join(fallback.select(*PAGE, F.col("narration").alias("__fall")), PAGE, "left")
    return rows.select(*PAGE, F.coalesce(text, F.col("__fall")).alias("narration"), text.isNull().alias("missing"))


def kept_pages(pages: DataFrame, written: DataFrame) -> DataFrame:
    """NAR-8: written texts of known pages, stripped, without blank ones."""
    rows = written.join(pages.select(*PAGE), PAGE, "left_semi").withColumn("narration", stripped(F.col("narration")))
    return rows.filter("narration <> ''").select(*PAGE, "narration")


def fill_missing(wanted: DataFrame, answers: DataFrame, kept: DataFrame, fallback: DataFrame) -> DataFrame:
    """NAR-9: kept texts, then answers for other pages, stripped and without blank ones, then the fallback; ``origin`` says which."""
    ask = wanted.select(*PAGE).join(kept, PAGE, "left_anti")
    said = answers.select(*PAGE, stripped(F.col("narration")).alias("narration")).filter("narration <> ''")
    got = ask.join(said, PAGE)
    rest = ask.join(got, PAGE, "left_anti").join(fallback.select(*PAGE, "narration"), PAGE)
    tag = lambda df, name: df.select(*PAGE, "narration", F.lit(name).alias("origin"))
    return tag(kept.join(wanted.select(*PAGE), PAGE, "left_semi"), "kept").unionByName(tag(got, "answer")).unionByName(tag(rest, "fallback"))


def trim_to(text: Column, limit: Column, marks: str = ENDS) -> Column:
    """NAR-11: whole sentences from the start as long as they fit; the first always stays."""
    parts = F.filter(F.split(text, f"(?<=[{marks}])"), lambda x: stripped(x) != "")
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))

    def step(acc: Column, part: Column) -> Column:
        over = acc["full"] | ((F.length(acc["t"]) > 0) & (F.length(acc["t"]) + F.length(part) > limit))
        return F.struct(F.when(over, acc["t"]).otherwise(F.concat(acc["t"], part)).alias("t"), over.alias("full"))

    cut = F.aggregate(parts, start, step, lambda acc: acc["t"])
    return F.when((F.length(text) <= limit) | (F.size(parts) <= 1), text).otherwise(cut)


def fit_duration(
    drafts: DataFrame, budgets: DataFrame, intents: DataFrame, pace: float = PACE, silence: float = LEAD + TAIL, marks: str = ENDS
) -> DataFrame:
    """NAR-10: ``project_id, page_index, narration, trimmed, short``: scripts over 110 % of the target lose sentences.

    Pages are cut in order of how far they exceed their budget (less if emphasised) until the script fits. A page is
    cut if the total less the savings of all before it is still too long, so the loop is a running sum. ``frozen``
    drafts are never cut. ``short`` marks scripts under 90 %.
    """
    rows = drafts.join(budgets, PAGE).join(intents.select("project_id", "duration", "emphasis_pages"), "project_id")
    deck = Window.partitionBy("project_id")
    spoken = F.length("narration") / pace
    rows = rows.withColumn("__total", F.sum(F.length("narration")).over(deck) / pace + silence * F.count("*").over(deck))
    excess = spoken - F.col("budget")
    able = ~F.coalesce(F.col("frozen"), F.lit(False)) & (excess > 0)
    cut = F.when(able, trim_to(F.col("narration"), F.floor(F.col("budget") * pace), marks)).otherwise(F.col("narration"))
    rank = excess * F.when(F.array_contains("emphasis_pages", F.col("page_index")), 0.4).otherwise(1.0)
    rows = rows.withColumns({"__cut": cut, "__able": able, "__rank": rank})
    rows = rows.withColumn("__saved", F.greatest(F.lit(0), F.length("narration") - F.length("__cut")))
    before = deck.orderBy(F.desc(F.col("__able").cast("int")), F.desc("__rank"), F.desc("page_index")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__total") - F.coalesce(F.sum("__saved").over(before), F.lit(0)) / pace
    take = (left > F.col("duration") * (1 + TOLERANCE)) & (F.col("__saved") > 0)
    short = F.col("__total") < F.col("duration") * (1 - TOLERANCE)
    rows = rows.withColumns({"trimmed": take, "short": short})
    return rows.select(*PAGE, F.when(F.col("trimmed"), F.col("__cut")).otherwise(F.col("narration")).alias("narration"), "trimmed", "short")


def nearest_written(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """NAR-13: ``before, after``: the written text of the nearest earlier and later page."""
    order = Window.partitionBy("project_id").orderBy("page_index")
    rows = pages.select(*PAGE).join(kept.select(*PAGE, "narration"), PAGE, "left")
    back = F.last("narration", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    on = F.first("narration", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return rows.select(*PAGE, back.alias("before"), on.alias("after"))


def narration_batches(pages: DataFrame, kept: DataFrame, size: int = 4) -> DataFrame:
    """NAR-14: ``batch, page_indexes`` of batches that have a page without text."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("page_index"))
    rows = pages.select(*PAGE).join(kept.select(*PAGE, F.lit(True).alias("__kept")), PAGE, "left")
    rows = rows.withColumn("batch", F.floor((place - 1) / size).cast("int"))
    done = F.bool_and(F.coalesce("__kept", F.lit(False)))
    grouped = rows.groupBy("project_id", "batch").agg(F.array_sort(F.collect_list("page_index")).alias("page_indexes"), done.alias("__done"))
    return grouped.filter("not __done").drop("__done")


def rewrite_scenes(scenes: DataFrame, edits: DataFrame, pace: float = PACE) -> DataFrame:
    """NAR-15: scenes with an edit get its text and a new estimate; a blank edit is ignored."""
    new = edits.select("project_id", "scene_id", F.nullif(stripped(F.col("narration")), F.lit("")).alias("__new"))
    rows = scenes.join(new, ["project_id", "scene_id"], "left")
    changed = F.col("__new").isNotNull()
    seconds = F.when(changed, F.round(estimate_duration(F.col("__new"), pace=pace), 3)).otherwise(F.col("duration"))
    return rows.withColumns({"duration": seconds, "narration": F.coalesce("__new", "narration")}).drop("__new")


def resolve_script_keys(scripts: DataFrame, scenes: DataFrame) -> DataFrame:
    """NAR-16: ``project_id, key, source_page``: keys are page numbers or scene ids; null if it can't be placed."""
    ids = scenes.select("project_id", F.col("scene_id").alias("key"), F.col("source_page").alias("__page"))
    rows = scripts.join(ids, ["project_id", "key"], "left")
    number = F.expr("try_cast(key AS int)")
    known = scenes.select("project_id", F.col("source_page").alias("__n")).distinct().withColumn("__known", F.lit(True))
    rows = rows.withColumn("__n", number).join(known, ["project_id", "__n"], "left")
    return rows.select("project_id", "key", F.coalesce("__page", F.when(F.col("__known"), F.col("__n"))).alias("source_page"))


# Timing -------------------------------------------------------------------------------------------------------------


def unit_windows(units: DataFrame) -> DataFrame:
    """TIM-3: ``start, end`` of units ``gap, duration`` laid end to end in each scene."""
    run = Window.partitionBy(*PAGE).orderBy("unit_seq")
    end = F.sum(F.col("gap") + F.col("duration")).over(run)
    return units.withColumn("end", end).withColumn("start", F.col("end") - F.col("duration"))


def thousandths(c: Column) -> Column:
    """To 3 decimals, half up, by the same few double operations in any engine."""
    return F.floor(c * 1000 + 0.5) / 1000.0


def _weights(segments: DataFrame) -> DataFrame:
    """Sentences with their weights in whole microseconds, so that sums are exact whatever their order."""
    weight = F.floor(F.greatest(estimate_duration(F.col("text")), F.lit(0.05)) * 1e6).cast("long")
    run = Window.partitionBy(*PAGE).orderBy("seg_seq")
    whole = Window.partitionBy(*PAGE)
    return segments.withColumn("__w", weight).withColumns(
        {"__to": F.sum("__w").over(run), "__all": F.sum("__w").over(whole), "__last": F.max("seg_seq").over(whole) == F.col("seg_seq")}
    )


def allocate_segments(segments: DataFrame, totals: DataFrame) -> DataFrame:
    """TIM-4: ``seg_seq, start, end``: a clip's ``total`` seconds over its sentences by weight; the last end is the total."""
    rows = _weights(segments).join(totals.select(*PAGE, "total"), PAGE).filter("total > 0")
    at = lambda c: thousandths(F.col("total") * c / F.col("__all"))
    end = F.when(F.col("__last"), thousandths(F.col("total"))).otherwise(at(F.col("__to")))
    return rows.select(*PAGE, "seg_seq", at(F.col("__to") - F.col("__w")).alias("start"), end.alias("end"))


def timed_sentences(text: Column, total: Column, marks: str = SENTENCES) -> Column:
    """NAR-5 and TIM-4 of a page in its row: its sentences in order, ``seg_seq, text, start, end``, so no text and no time moves."""
    weight = lambda t: F.floor(F.greatest(estimate_duration(t), F.lit(0.05)) * 1e6).cast("long")

    def timed(s: Column, w: Column, to: Column, total: Column) -> Column:
        at = lambda c: thousandths(total * c / F.get(to, F.size(to) - 1))
        end = lambda i: F.when(i + 1 == F.size(s), thousandths(total)).otherwise(at(F.get(to, i)))
        return F.transform(s, lambda t, i: F.struct((i + 1).alias("seg_seq"), t.alias("text"), at(F.get(to, i) - F.get(w, i)).alias("start"), end(i).alias("end")))

    weighed = lambda s, t: bound(F.transform(s, weight), lambda w: bound(running(w), lambda to: timed(s, w, to, t)))
    parts = F.when(total > 0, sentences(text, marks)).otherwise(F.array().cast("array<string>"))
    return bound(parts, lambda s: bound(total, lambda t: weighed(s, t)))


def expected_boundaries(segments: DataFrame, totals: DataFrame) -> DataFrame:
    """TIM-5: ``seg_seq, expected``: where each sentence but the last should end."""
    rows = _weights(segments).join(totals.select(*PAGE, "total"), PAGE).filter("not __last")
    return rows.select(*PAGE, "seg_seq", thousandths(F.col("total") * F.col("__to") / F.col("__all")).alias("expected"))


def time_segments(provider: DataFrame, silence: DataFrame, estimate: DataFrame) -> DataFrame:
    """TIM-7: each scene's times from one source: the voice's own, else from pauses, else estimated."""
    pause = silence.join(provider.select(*PAGE).distinct(), PAGE, "left_anti")
    have = provider.select(*PAGE).unionByName(silence.select(*PAGE)).distinct()
    rest = estimate.join(have, PAGE, "left_anti")
    tag = lambda df, name: df.select(*PAGE, "seg_seq", "start", "end", F.lit(name).alias("timing_source"))
    return tag(provider, "provider").unionByName(tag(pause, "silence")).unionByName(tag(rest, "estimate"))


def shift_segments(timed: DataFrame, lead: float = LEAD) -> DataFrame:
    """TIM-8: times moved on by the lead, to 3 decimals."""
    return timed.withColumns({c: thousandths(F.col(c) + lead) for c in ("start", "end")})


def voice_fingerprint(narration: Column, engine: str, voice: str, rate: float, lead: float = LEAD, tail: float = TAIL) -> Column:
    """TIM-9: the first 16 hex digits of a SHA-256 over all that a recording depends on."""
    return F.substring(F.sha2(F.concat_ws("|", narration, *[F.lit(str(x)) for x in (engine, voice, rate, lead, tail)]), 256), 1, 16)


def scenes_to_voice(scenes: DataFrame, prior: DataFrame, force: bool = False) -> DataFrame:
    """TIM-9: scenes whose recording is missing or was made from something else: ``project_id, scene_id, reason``.

    ``scenes`` and ``prior`` have ``fingerprint``; ``prior`` also ``path``.
    """
    old = prior.select("project_id", "scene_id", F.col("fingerprint").alias("__old"), F.col("path").alias("__path"))
    rows = scenes.join(old, ["project_id", "scene_id"], "left")
    reason = F.when(F.lit(force), "forced").when(F.col("__old").isNull(), "new").when(F.col("__path").isNull(), "missing")
    reason = reason.when(~F.col("__old").eqNullSafe(F.col("fingerprint")), "changed")
    return rows.select("project_id", "scene_id", reason.alias("reason")).filter("reason is not null")


def voice_table(spark: SparkSession, path: str) -> Versions:
    """TIM-9: where the fingerprints and files of recordings are kept, a version for each run."""
    return Versions(spark, path, "project_id string, scene_id string, fingerprint string, path string")


def voice_run(scenes: DataFrame, table: Versions, run: int, force: bool = False) -> DataFrame:
    """TIM-9: the scenes that run number ``run`` must record after all runs before it; then the run's recordings are kept.

    ``scenes`` have ``fingerprint`` and ``path``, the file that there will be (null: it gets lost). Run again under its number,
    a run gives the same rows and keeps the same.
    """
    before = last_of(table.rows().filter(F.col("version") < run), "project_id")
    todo = stored(scenes_to_voice(scenes, before, force), "to-voice")
    table.put(scenes.select("project_id", "scene_id", "fingerprint", "path"), run)
    return todo


def longest_unbroken(pauses: DataFrame, scenes: DataFrame) -> DataFrame:
    """TIM-10: ``longest``: the longest stretch between 0, the middles of pauses and the scene's end."""
    marks = scenes.select(*PAGE, F.lit(0.0).alias("at")).unionByName(scenes.select(*PAGE, F.col("duration").alias("at")))
    middle = (F.greatest(F.col("end") - F.col("duration"), F.lit(0.0)) + F.col("end")) / 2
    marks = marks.unionByName(pauses.select(*PAGE, middle.alias("at")))
    step = F.lead("at").over(Window.partitionBy(*PAGE).orderBy("at")) - F.col("at")
    return marks.withColumn("step", step).groupBy(*PAGE).agg(thousandths(F.max("step")).alias("longest"))


def total_duration(scenes: DataFrame) -> DataFrame:
    """TIM-11: each project's seconds."""
    return scenes.groupBy("project_id").agg(F.round(F.sum("duration"), 3).alias("duration"))


def transitions(spark: SparkSession) -> DataFrame:
    """Opening lines by the place of a page among its deck's, modulo five."""
    lines = ["我们先从%s说起。", "接着来看%s。", "在此基础上，%s。", "说到这里，就要提到%s。", "顺着这个思路，%s。"]
    return spark.createDataFrame(list(enumerate(lines)), "turn int, line string")
