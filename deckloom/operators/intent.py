"""Rules that read wishes from messages: pages, pronunciations, lengths and what must be made anew."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.functions.text import bound, through_last

SOUND_FIELDS = ("voice", "speech_rate", "pronunciation", "instructions")
INTENT_FIELDS = ("audience", "style", "tone", "language", "duration", "voice", "speech_rate", "instructions")


# How a message names pages, one by one and as a range, and words that ask for emphasis. Between the tilde and
# the dash in brackets lies a range of characters.
PAGE = r"第\s*(\d+)\s*[页頁]"
PAGE_RANGE = r"第?\s*(\d+)\s*[~-—到至]\s*(\d+)\s*[页頁]"
#: What a page's name ends in.
PAGE_ENDS = "页頁"
EMPHASIS = ("重点", "详细")
#: A deck has no more pages than this where their number isn't known.
MOST_PAGES = 9999


def page_mentions(text: Column, most: Column | int = MOST_PAGES) -> Column:
    """INT-3: the distinct pages from 1 to ``most`` that a message names, in order.

    If it names ranges, single pages don't count; a range from high to low names none. Numbers of any length are read, and
    ranges are cut to the deck before their pages are listed. A null message names none.
    """
    most = F.lit(most).cast("bigint") if isinstance(most, int) else most.cast("bigint")
    return bound(through_last(F.coalesce(text, F.lit("")), PAGE_ENDS), lambda t: _mentions(t, most))


def _mentions(text: Column, most: Column) -> Column:
    number = lambda x: F.coalesce(x.try_cast("bigint"), most + 1)
    lows, highs, single = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for pattern, k in ((PAGE_RANGE, 1), (PAGE_RANGE, 2), (PAGE, 1)))
    none = F.array().cast("array<bigint>")

    def span(x: Column, i: Column) -> Column:
        low, high = F.greatest(number(x), F.lit(1)), F.least(number(F.get(highs, i)), most)
        return F.when(low <= high, F.sequence(low, high)).otherwise(none)

    singles = F.filter(F.transform(single, number), lambda p: (p >= 1) & (p <= most))
    pages = F.when(F.size(lows) > 0, F.flatten(F.transform(lows, span))).otherwise(singles)
    return F.array_sort(F.array_distinct(pages)).cast("array<int>")


def pronunciations(text: Column) -> Column:
    """INT-5: a map from ``X 念/读作/读成 Y``; the last reading of a word wins."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9+]{1,15}\s*(?:念|读作|读成)\s*[A-Za-z0-9][A-Za-z0-9 ]{0,23}"), F.lit(0))
    part = lambda x, k: F.trim(F.regexp_extract(x, r"^([A-Za-z0-9+]+)\s*(?:念|读作|读成)\s*(.+)$", k))
    pairs = F.transform(found, lambda x: F.struct(part(x, 1).alias("key"), part(x, 2).alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def sanitize_intent(intents: DataFrame) -> DataFrame:
    """INT-6: length within 15..7200 seconds; page lists distinct, sorted and within the deck (9999 pages if unknown)."""
    pages = F.when(F.col("page_count") > 0, F.col("page_count")).otherwise(9999)
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: (x >= 1) & (x <= pages))))
    return intents.withColumns({
        "duration": F.greatest(F.lit(15), F.least(F.lit(7200), F.col("duration"))),
        "emphasis_pages": clean("emphasis_pages"),
        "skip_pages": clean("skip_pages"),
    })


def intent_diff(before: DataFrame, after: DataFrame, fields: tuple[str, ...] = INTENT_FIELDS) -> DataFrame:
    """INT-8: ``project_id, changed, sound_only``: fields that differ, and whether they only touch the voice."""
    old = before.select("project_id", *[F.col(c).alias(f"__{c}") for c in fields])
    rows = after.join(old, "project_id")
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in fields]))
    rows = rows.select("project_id", differ.alias("changed"))
    outside = F.array_except("changed", F.array(*[F.lit(c) for c in SOUND_FIELDS]))
    return rows.withColumn("sound_only", (F.size("changed") > 0) & (F.size(outside) == 0))


# Lengths ------------------------------------------------------------------------------------------------------------

# Chinese digits, and the numbers that they stand for at the same place.
CN_DIGITS, CN_VALUES = "零〇一二两三四五六七八九", "001223456789"
_NUM = rf"(\d+(?:\.\d+)?|[{CN_DIGITS}十]{{1,3}})"


def parse_number(text: Column) -> Column:
    """INT-1: a number in digits, or in Chinese from 0 to 99, where 十 is a place; null for anything else."""
    t = F.trim(text)
    one = rf"^[{CN_DIGITS}]$"
    digit = lambda c: F.translate(c, CN_DIGITS, CN_VALUES).cast("double")
    tens = F.regexp_extract(t, rf"^([{CN_DIGITS}]?)十[{CN_DIGITS}]?$", 1)
    ones = F.regexp_extract(t, rf"^[{CN_DIGITS}]?十([{CN_DIGITS}]?)$", 1)
    place = F.when(tens == "", 1.0).otherwise(digit(tens)) * 10 + F.when(ones == "", 0.0).otherwise(digit(ones))
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double")).when(t.rlike(one), digit(t)).when(t.rlike(rf"^[{CN_DIGITS}]?十[{CN_DIGITS}]?$"), place)


def _found(text: Column, pattern: str, k: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


# How a message names a length in minutes (pattern, minutes of one, minutes that a half adds) in this order, and one in
# minutes and seconds or in seconds.
MINUTES = (
    (rf"{_NUM}\s*个?\s*(?:小时|钟头)(半)?", 60, 30.0),
    (r"半\s*(?:小时|个小时|钟头)", 0, 30.0),
    (rf"{_NUM}\s*分\s*(钟|半)", 1, 0.5),
    (r"半\s*分钟", 0, 0.5),
)
#: What every length ends in.
LENGTH_ENDS = "时头钟半秒"
MINUTES_AND_SECONDS, SECONDS = rf"{_NUM}\s*分\s*{_NUM}\s*秒", rf"{_NUM}\s*秒"


def lengths(text: Column) -> tuple[Column, Column, Column]:
    """INT-2: the minutes and the seconds that a message names (null if none), and whether the seconds come with minutes."""
    named = []
    for pattern, one, half in MINUTES:
        if one:
            more = F.when(F.regexp_extract(text, pattern, 2) == "半", half).otherwise(0.0)
            named.append(parse_number(_found(text, pattern)) * one + more)
        else:
            named.append(F.when(text.rlike(pattern), half))
    both = parse_number(_found(text, MINUTES_AND_SECONDS, 1)) * 60 + parse_number(_found(text, MINUTES_AND_SECONDS, 2))
    return F.coalesce(*named), F.coalesce(both, parse_number(_found(text, SECONDS))), text.rlike(MINUTES_AND_SECONDS)


def stated_duration(text: Column) -> Column:
    """INT-2: the length in seconds that a message asks for; null if it names none."""

    def stated(t: Column) -> Column:
        minutes, seconds, both = lengths(t)
        return F.when(both, seconds).otherwise(F.coalesce(minutes * 60, seconds))

    return bound(through_last(text, LENGTH_ENDS), stated)


# Wishes -------------------------------------------------------------------------------------------------------------

# Words for a style, and the tone that a style implies.
STYLES = {"专业": "professional", "科技": "tech", "活泼": "lively", "轻松": "casual", "正式": "formal"}
STYLE_TONES = {
    "professional": "清晰、稳重",
    "tech": "干脆、重逻辑",
    "lively": "轻快、有起伏",
    "casual": "放松、像同事之间讲事",
    "formal": "持重、书面",
}
# Words for a tone.
TONES = {
    "亲切": "亲切、像在跟人聊",
    "热情": "热情、有推进感",
    "沉稳": "沉稳、不急不缓",
    "稳重": "清晰、稳重",
    "严肃": "严肃、克制",
    "干脆": "干脆、句子短",
    "冷静": "冷静、只讲事实",
    "幽默": "轻快、偶尔带一点玩笑",
    "年轻": "年轻、口语化",
}
# Words for an audience, and for a rate of speech (longer phrases first).
AUDIENCES = {"客户": "企业客户", "开发者": "技术人员", "技术": "技术人员", "投资": "投资人"}
RATES = {
    "再慢一点": 0.85, "慢很多": 0.85, "太快了": 0.85, "再快一点": 1.25, "快很多": 1.25, "慢一点": 0.9, "慢些": 0.9, "放慢": 0.9,
    "快一点": 1.12, "快些": 1.12, "加快": 1.12, "太慢了": 1.12,
}


def _first_of(text: Column, words: dict) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(v)) for w, v in words.items()])


def parse_intent(messages: DataFrame, current: DataFrame) -> DataFrame:
    """INT-4: each message's wishes over the project's present ``style, tone, audience, speech_rate, duration``.

    A style brings its tone; a tone in words wins; what isn't mentioned, or a null message, keeps what is there. With a word of
    emphasis the pages that the message names join ``current``'s ``emphasis_pages`` (null: none).
    """
    fields = ("style", "tone", "audience", "speech_rate", "duration")
    now = current.select("project_id", *[F.col(c).alias(f"__{c}") for c in (*fields, "emphasis_pages")])
    rows = messages.join(now, "project_id")
    text = F.coalesce("text", F.lit(""))
    style = _first_of(text, STYLES)
    implied = F.try_element_at(F.create_map(*[F.lit(x) for kv in STYLE_TONES.items() for x in kv]), style)
    rate, seconds = _first_of(text, RATES), F.floor(stated_duration(text)).cast("int")
    new = {"style": style, "tone": F.coalesce(_first_of(text, TONES), implied), "audience": _first_of(text, AUDIENCES), "speech_rate": rate, "duration": seconds}
    zoom = F.contains(text, F.lit("放大")) & (F.contains(text, F.lit("数字")) | F.contains(text, F.lit("数据")))
    none = F.array().cast("array<int>")
    pages = F.concat(F.coalesce("__emphasis_pages", none), F.when(_any(text, EMPHASIS), page_mentions(text)).otherwise(none))
    emphasis = F.array_sort(F.array_distinct(pages)).alias("emphasis_pages")
    return rows.select("project_id", "message_id", *[F.coalesce(c, F.col(f"__{k}")).alias(k) for k, c in new.items()], emphasis, zoom.alias("zoom_on_key_data"))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


# Words that ask for another voice, for other moves, and for a new script; and what a summary says.
REVOICE = ("音色", "声音", "配音", "语速", "换个声音")
REDIRECT = ("放大", "高亮", "镜头", "聚焦", "指针")
REWRITE = ("整体重写", "全部重写", "重写讲稿")
SUMMARY = {"scenes": "修改 %d 个场景", "duration": "总时长调整为 %d 秒", "revoice": "重新配音", "redirect": "重做镜头", "nothing": "按指令更新工程并重新渲染"}


def parse_edits(messages: DataFrame, scenes: DataFrame, current: DataFrame) -> DataFrame:
    """INT-7: what a message asks to change: ``scene_ids`` of the pages that it names (numbers of any length), ``target_seconds`` for them, else the
    whole film's ``duration``; ``revoice, redirect, rewrite_all``; and a ``summary``."""
    text = F.coalesce("text", F.lit(""))
    pages = F.transform(F.regexp_extract_all(through_last(text, PAGE_ENDS), F.lit(PAGE), F.lit(1)), lambda p: p.try_cast("bigint"))
    length = bound(through_last(text, LENGTH_ENDS), lambda t: F.struct(*[c.alias(k) for k, c in zip(("min", "sec"), lengths(t), strict=False)]))
    rows = messages.join(current.select("project_id", F.col("duration").alias("__d")), "project_id")
    rows = rows.withColumns({"__pages": pages, "__len": length}).withColumns({"__min": F.col("__len.min"), "__sec": F.col("__len.sec")})
    named = rows.select("project_id", "message_id", F.posexplode("__pages").alias("__i", "source_page"))
    named = named.join(scenes.select("project_id", "source_page", "scene_id"), ["project_id", "source_page"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("__i", "scene_id"))), lambda x: x["scene_id"])
    rows = rows.join(named.groupBy("project_id", "message_id").agg(ids.alias("scene_ids")), ["project_id", "message_id"], "left")
    mentions = F.size("__pages") > 0
    target = F.coalesce("__sec", F.when(mentions, F.col("__min") * 60), F.lit(0.0))
    asked = F.when(mentions, None).when(F.col("__sec").isNull(), F.col("__min") * 60).when(F.col("__min").isNull() & (F.col("__sec") != 0), F.col("__sec"))
    rows = rows.withColumns({
        "scene_ids": F.coalesce("scene_ids", F.array().cast("array<string>")),
        "target_seconds": target,
        "duration": F.coalesce(F.floor(asked).cast("int"), F.col("__d")),
        "revoice": _any(text, REVOICE),
        "redirect": _any(text, REDIRECT),
        "rewrite_all": _any(text, REWRITE),
    })
    parts = [
        F.when(F.size("scene_ids") > 0, F.format_string(SUMMARY["scenes"], F.size("scene_ids"))),
        F.when(F.col("duration") != F.col("__d"), F.format_string(SUMMARY["duration"], "duration")),
        F.when(F.col("revoice"), SUMMARY["revoice"]),
        F.when(F.col("redirect"), SUMMARY["redirect"]),
    ]
    said = F.concat_ws("；", *parts)
    summary = F.when(said == "", SUMMARY["nothing"]).otherwise(said)
    return rows.select("project_id", "message_id", "scene_ids", "target_seconds", "duration", "revoice", "redirect", "rewrite_all", summary.alias("summary"))


def recompute_plan(edits: DataFrame) -> DataFrame:
    """INT-9: ``stages, scene_ids``: the least that must run again for an edit.

    ``edits`` have ``scene_ids, revoice, redirect, rewrite_all, intent_changed, sound_only``. A rewrite, or a change of
    more than the voice that names no scenes, runs all from the script on, for all scenes.
    """
    stages = lambda *s: F.array(*[F.lit(x) for x in s])
    script = stages("narrate", "voice", "direct", "motion", "render", "review")
    named = F.size("scene_ids") > 0
    whole = F.col("rewrite_all") | (F.col("intent_changed") & ~named & ~F.col("sound_only"))
    run = F.when(whole | named, script).when(F.col("redirect"), stages("direct", "motion", "render", "review"))
    run = run.when(F.col("revoice"), stages("voice", "motion", "render", "review")).otherwise(stages("motion", "render"))
    ids = F.when(named & ~whole, F.col("scene_ids")).otherwise(F.array().cast("array<string>"))
    return edits.select("project_id", "message_id", run.alias("stages"), ids.alias("scene_ids"))
