"""Queries over messages, with their SQL twins. The tables at hand hold no Chinese requests, so each document's number picks
the phrases of one, which stand before the document's whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.operators import intent
from deckloom.plans import fixtures
from deckloom.plans.fixtures import with_ctes
from deckloom.plans.narration_queries import scenes

LENGTHS = (
    "做一个七分钟左右的讲解视频", "5 分 30 秒", "一个小时半", "两小时讲完", "半小时", "十二分半", "半分钟就好", "45秒以内", "二十五分钟", "随便做",
    "这部分十分重要", "二十十秒", "1.5 分钟",
)
WISHES = (
    "专业一点，但亲切", "活泼些，给客户看", "面向开发者，放慢", "投资人要看，再快一点", "再慢一点", "第 3 页放大数据", "换个声音", "整体重写", "科技风，太慢了",
    "RAG 念 R A G，API读作A P I", "第2页和第 1 页重做镜头", "严肃，快一点",
    "第2~3页重点讲", "详细讲第 4 页，第 99999999999 页不要", "第3到20000000页详细些", "第9至2页重点，第 1 页略过",
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("project_id"), F.col("doc_id").alias("message_id"), "text")
    pick = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("message_id") % k + 1).cast("int"))
    return d.withColumn("text", F.concat_ws("，", pick(LENGTHS, len(LENGTHS)), pick(WISHES, len(WISHES)), "text"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("project_id"), F.col("source").alias("style"), F.lit("清晰").alias("tone"), F.col("lang").alias("audience"), F.lit(1.0).alias("speech_rate"), F.lit(480).alias("duration"), F.array(F.lit(5), F.lit(2)).alias("emphasis_pages")
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intent.parse_edits(messages(spark, sf_dir), scenes(spark, sf_dir), current(spark, sf_dir))


def recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intent has changed in every second message, and by its voice alone in every sixth."""
    n = F.col("message_id")
    return intent.recompute_plan(edits(spark, sf_dir).withColumns({"intent_changed": n % 2 == 0, "sound_only": n % 6 == 0}))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number in the whole text of every message."""
    found = messages(spark, sf_dir).select("message_id", F.posexplode(F.regexp_extract_all("text", F.lit(intent._NUM), F.lit(0))).alias("place", "n"))
    return found.select("message_id", "place", intent.parse_number(F.col("n")).alias("number"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("message_id", F.explode(intent.pronunciations(F.col("text"))).alias("term", "spoken"))


QUERIES = {
    "int1_numbers": numbers,
    "int2_durations": lambda spark, sf_dir: messages(spark, sf_dir).select("message_id", intent.stated_duration(F.col("text")).alias("seconds")),
    "int3_page_mentions": lambda spark, sf_dir: messages(spark, sf_dir).select("message_id", intent.page_mentions(F.col("text")).alias("pages")),
    "int4_intents": lambda spark, sf_dir: intent.parse_intent(messages(spark, sf_dir), current(spark, sf_dir)),
    "int5_readings": readings,
    "int7_edits": edits,
    "int9_recompute": recompute,
}

_D = "[零〇一二两三四五六七八九]"
_N = r"(\d+(?:\.\d+)?|[零〇一二两三四五六七八九十]{1,3})"


def _number(c: str) -> str:
    digit = lambda x: f"translate({x}, '零〇一二两三四五六七八九', '001223456789')::DOUBLE"
    tens, ones = f"regexp_extract({c}, '^({_D}?)十{_D}?$', 1)", f"regexp_extract({c}, '^{_D}?十({_D}?)$', 1)"
    return (
        rf"CASE WHEN regexp_matches({c}, '^\d+(\.\d+)?$') THEN try_cast({c} AS DOUBLE) WHEN regexp_matches({c}, '^{_D}$') THEN {digit(c)} WHEN regexp_matches({c}, '^{_D}?十{_D}?$') "
        f"THEN CASE {tens} WHEN '' THEN 1 ELSE {digit(f'nullif({tens}, {chr(39) * 2})')} END * 10 + CASE {ones} WHEN '' THEN 0 ELSE {digit(f'nullif({ones}, {chr(39) * 2})')} END END"
    )


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _case(words: dict) -> str:
    return "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN {repr(v)}" for w, v in words.items()) + " END"


_ANY = lambda *words: f"regexp_matches(text, '{'|'.join(words)}')"
fixtures.CTES |= {
    "messages": f"""
SELECT doc_id::VARCHAR AS project_id, doc_id AS message_id, source, lang, concat_ws('，', {_list(LENGTHS)}[(doc_id % {len(LENGTHS)} + 1)::INT], {_list(WISHES)}[(doc_id % {len(WISHES)} + 1)::INT], text) AS text FROM documents
""",
    "lengths": f"""
SELECT *, coalesce(CASE WHEN h IS NOT NULL THEN h * 60 + CASE WHEN h_half <> '' THEN 30 ELSE 0 END END, CASE WHEN regexp_matches(text, '半\\s*(?:小时|个小时|钟头)') THEN 30 END,
    m + CASE WHEN m_half = '半' THEN 0.5 ELSE 0 END, CASE WHEN regexp_matches(text, '半\\s*分钟') THEN 0.5 END)::DOUBLE AS minutes, coalesce(a * 60 + b, s) AS seconds
FROM (
  SELECT *, {_number("h_text")} AS h, {_number("m_text")} AS m, {_number("a_text")} AS a, {_number("b_text")} AS b, {_number("s_text")} AS s FROM (
    SELECT *, regexp_extract(text, '{_N}\\s*个?\\s*(?:小时|钟头)(半)?', 1) AS h_text, regexp_extract(text, '{_N}\\s*个?\\s*(?:小时|钟头)(半)?', 2) AS h_half,
      regexp_extract(text, '{_N}\\s*分\\s*(钟|半)', 1) AS m_text, regexp_extract(text, '{_N}\\s*分\\s*(钟|半)', 2) AS m_half,
      regexp_extract(text, '{_N}\\s*分\\s*{_N}\\s*秒', 1) AS a_text, regexp_extract(text, '{_N}\\s*分\\s*{_N}\\s*秒', 2) AS b_text, regexp_extract(text, '{_N}\\s*秒', 1) AS s_text FROM messages))
""",
    "edited": f"""
SELECT l.project_id, l.message_id, coalesce(ids, []) AS scene_ids, coalesce(seconds, CASE WHEN len(pages) > 0 THEN minutes * 60 END, 0) AS target_seconds,
  coalesce(floor(CASE WHEN len(pages) > 0 THEN NULL WHEN seconds IS NULL THEN minutes * 60 WHEN minutes IS NULL AND seconds <> 0 THEN seconds END)::INT, 480) AS duration,
  {_ANY("音色", "声音", "配音", "语速")} AS revoice, {_ANY("放大", "高亮", "镜头", "聚焦", "指针")} AS redirect, {_ANY("整体重写", "全部重写", "重写讲稿")} AS rewrite_all
FROM (SELECT *, list_transform(regexp_extract_all(text, '第\\s*(\\d+)\\s*[页頁]', 1), lambda p : try_cast(p AS BIGINT)) AS pages FROM lengths) l
LEFT JOIN (
  SELECT m.message_id, list(s.scene_id ORDER BY m.i) AS ids
  FROM (SELECT project_id, message_id, unnest(pages) AS page, unnest(range(0, len(pages))) AS i
    FROM (SELECT *, list_transform(regexp_extract_all(text, '第\\s*(\\d+)\\s*[页頁]', 1), lambda p : try_cast(p AS BIGINT)) AS pages FROM messages)) m
  JOIN scenes s ON s.project_id = m.project_id AND s.source_page = m.page GROUP BY m.message_id
) i USING (message_id)
""",
}
fixtures.NEEDS |= {"lengths": ["messages"], "edited": ["lengths", "scenes"]}

_RANGE = r"第?\s*(\d+)\s*[~-—到至]\s*(\d+)\s*[页頁]"
_PAGES = rf"""
list_sort(list_distinct(CASE WHEN regexp_matches(text, '{_RANGE}') THEN
  flatten(list_transform(list_zip(regexp_extract_all(text, '{_RANGE}', 1), regexp_extract_all(text, '{_RANGE}', 2)),
    lambda z: range(greatest(coalesce(try_cast(z[1] AS BIGINT), 10000), 1), least(coalesce(try_cast(z[2] AS BIGINT), 10000), 9999) + 1)))
  ELSE list_filter(list_transform(regexp_extract_all(text, '第\s*(\d+)\s*[页頁]', 1), lambda p: try_cast(p AS BIGINT)), lambda p: p BETWEEN 1 AND 9999) END))"""
_DURATION = rf"CASE WHEN regexp_matches(text, '{_N}\s*分\s*{_N}\s*秒') THEN seconds ELSE coalesce(minutes * 60, seconds) END"
SQL = {
    "int1_numbers": with_ctes(
        "messages",
        f"""
, found AS (SELECT message_id, regexp_extract_all(text, '{_N}') AS n FROM messages)
SELECT message_id, place::INT AS place, {_number("t")} AS number FROM (SELECT message_id, unnest(n) AS t, unnest(range(len(n))) AS place FROM found)""",
    ),
    "int3_page_mentions": with_ctes("messages", f"SELECT message_id, {_PAGES} AS pages FROM messages"),
    "int2_durations": with_ctes("lengths", f"SELECT message_id, {_DURATION} AS seconds FROM lengths"),
    "int4_intents": with_ctes(
        "lengths",
        f"""
SELECT project_id, message_id, coalesce(named, source) AS style, coalesce({_case(intent.TONES)}, CASE named {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in intent.STYLE_TONES.items())} END, '清晰') AS tone,
  coalesce({_case(intent.AUDIENCES)}, lang) AS audience, coalesce({_case(intent.RATES)}, 1.0)::DOUBLE AS speech_rate, coalesce(floor({_DURATION})::INT, 480) AS duration,
  list_sort(list_distinct(list_concat([2, 5], CASE WHEN {_ANY("重点", "详细")} THEN {_PAGES} ELSE [] END)))::INT[] AS emphasis_pages,
  contains(text, '放大') AND (contains(text, '数字') OR contains(text, '数据')) AS zoom_on_key_data
FROM (SELECT *, {_case(intent.STYLES)} AS named FROM lengths)""",
    ),
    "int5_readings": with_ctes(
        "messages",
        r"""
, found AS (SELECT message_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+]{1,15}\s*(?:念|读作|读成)\s*[A-Za-z0-9][A-Za-z0-9 ]{0,23}')) AS f FROM messages)
SELECT message_id, regexp_extract(f, '^([A-Za-z0-9+]+)', 1) AS term, trim(regexp_extract(f, '(?:念|读作|读成)\s*(.+)$', 1)) AS spoken FROM found""",
    ),
    "int7_edits": with_ctes(
        "edited",
        """
SELECT *, CASE WHEN said = '' THEN '按指令更新工程并重新渲染' ELSE said END AS summary FROM (
  SELECT *, concat_ws('；', CASE WHEN len(scene_ids) > 0 THEN printf('修改 %d 个场景', len(scene_ids)) END, CASE WHEN duration <> 480 THEN printf('总时长调整为 %d 秒', duration) END,
    CASE WHEN revoice THEN '重新配音' END, CASE WHEN redirect THEN '重做镜头' END) AS said FROM edited)""",
    ).replace("SELECT *, CASE WHEN said", "SELECT * EXCLUDE (said), CASE WHEN said"),
    "int9_recompute": with_ctes(
        "edited",
        """
SELECT project_id, message_id, CASE WHEN whole OR len(scene_ids) > 0 THEN ['narrate', 'voice', 'direct', 'motion', 'render', 'review'] WHEN redirect THEN ['direct', 'motion', 'render', 'review']
  WHEN revoice THEN ['voice', 'motion', 'render', 'review'] ELSE ['motion', 'render'] END AS stages, CASE WHEN whole THEN [] ELSE scene_ids END AS scene_ids
FROM (SELECT *, rewrite_all OR (message_id % 2 = 0 AND len(scene_ids) = 0 AND message_id % 6 <> 0) AS whole FROM edited)""",
    ),
}
