"""Queries over targets and boxes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.functions import geometry
from deckloom.operators import attention
from deckloom.plans import fixtures
from deckloom.plans.doc_queries import elements, typed_pages
from deckloom.plans.fixtures import with_ctes
from deckloom.plans.narration_queries import segments

PAGE = ["project_id", "page_index"]


def titled(e: DataFrame, p: DataFrame) -> DataFrame:
    return e.join(p.select(*PAGE, "title"), PAGE)


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled(elements(spark, sf_dir), typed_pages(spark, sf_dir))


def tests_of_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _elements(spark, sf_dir)
    return e.select(*PAGE, "seq", attention.worth_pointing_at().alias("able"), attention.is_banner().alias("banner"), F.round(attention.coverage(), 6).alias("coverage"))


def references() -> Column:
    """Every third sentence names the element of its own number."""
    return F.when(F.col("seg_seq") % 3 == 0, F.array(F.format_string("p%02d_e%02d", "page_index", F.col("seg_seq")))).otherwise(F.array().cast("array<string>"))


def targets_of(s: DataFrame, e: DataFrame) -> DataFrame:
    return attention.resolve_targets(s.withColumn("element_refs", references()), e)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets_of(segments(spark, sf_dir), _elements(spark, sf_dir))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_of(segments(spark, sf_dir), elements(spark, sf_dir), typed_pages(spark, sf_dir))


def chosen_of(s: DataFrame, e: DataFrame, p: DataFrame) -> DataFrame:
    t = targets_of(s, titled(e, p)).join(e.select(*PAGE, "element_id", "importance"), [*PAGE, "element_id"])
    t = t.join(p.select(*PAGE, "page_type", attention.action_budget(F.length("raw_text") / 40.0).alias("budget")), PAGE)
    t = t.withColumns({"emphasis": F.col("seg_seq") % 4 == 0, "in_flow": F.col("seg_seq") % 5 == 0})
    return attention.drop_stutter(attention.rank_candidates(t)).select(*PAGE, "seg_seq", "element_id", F.round("score", 3).alias("score"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.elements(spark, sf_dir)
    box = [F.col(c) for c in "xywh"]
    area = geometry.to_frame_area(*box, F.lit(1600.0), F.lit(1200.0))
    rows = e.select(*PAGE, "seq", geometry.pad_highlight(area).alias("a"), geometry.padded(*box).alias("p"), geometry.center(*box).alias("c"))
    six = lambda c: F.round(c, 6)
    return rows.select(*PAGE, "seq", *[six(F.col(f"a.{k}")).alias(k) for k in "xywh"], six(F.col("p.x")).alias("px"), six(F.col("p.w")).alias("pw"), F.col("c.y").alias("cy"))


QUERIES = {"dir1_to_4_tests": tests_of_elements, "dir5_targets": targets, "dir8_to_10_chosen": chosen, "lay4_to_6_areas": areas}

fixtures.CTES |= {
    "able": r"""
SELECT c.*, t.title, kind IN ('chart', 'table', 'image') OR (length(trim(text)) >= 2 AND regexp_matches(text, '\p{L}')
  AND trim(lower(trim(text)), ' .、·:：') NOT IN ('contents', 'content', 'agenda', 'outline', 'index', 'thank you', 'thanks', 'logo')) AS able,
  kind = 'title' OR trim(text) <> '' AND trim(text) = trim(t.title) AS banner
FROM classified c JOIN (SELECT project_id, page_index, title FROM typed) t ON t.project_id = c.project_id AND t.page_index = c.page_index
""",
    "targets": """
SELECT s.project_id, s.page_index, s.seg_seq,
  coalesce(any_value(e.element_id) FILTER (s.seg_seq % 3 = 0 AND e.seq = s.seg_seq AND NOT e.banner),
    arg_min(e.element_id, (1 - e.importance) * 1000 + e.seq) FILTER (e.kind <> 'title' AND length(trim(e.text)) >= 2 AND contains(s.text, substr(trim(e.text), 1, 6)))) AS element_id
FROM segments s JOIN able e ON e.project_id = s.project_id AND e.page_index = s.page_index AND e.able
GROUP BY s.project_id, s.page_index, s.seg_seq HAVING element_id IS NOT NULL
""",
}
fixtures.NEEDS |= {"able": ["typed"], "targets": ["segments", "able"]}

SQL = {
    "dir1_to_4_tests": with_ctes("able", "SELECT project_id, page_index, seq, able, banner, round(w * h / (1920 * 1080), 6) AS coverage FROM able"),
    "dir5_targets": with_ctes("targets", "SELECT * FROM targets"),
    "dir8_to_10_chosen": with_ctes(
        "targets",
        """
, scored AS (
  SELECT t.project_id, t.page_index, t.seg_seq, t.element_id, greatest(2, least(8, round_even(length(raw_text) / 40.0::DOUBLE / 6, 0)::INT)) AS budget,
    e.importance + CASE WHEN t.seg_seq % 4 = 0 THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN t.seg_seq % 5 = 0 THEN 0.3 ELSE 0 END::DOUBLE AS score
  FROM targets t JOIN classified e USING (project_id, page_index, element_id) JOIN typed p USING (project_id, page_index) WHERE page_type NOT IN ('cover', 'section')
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, page_index ORDER BY score DESC, seg_seq) AS rank FROM scored
)
SELECT project_id, page_index, seg_seq, element_id, round(score, 3) AS score
FROM (SELECT *, lag(element_id) OVER (PARTITION BY project_id, page_index ORDER BY seg_seq) AS prior FROM ranked WHERE rank <= budget)
WHERE element_id IS DISTINCT FROM prior""",
    ),
    "lay4_to_6_areas": with_ctes(
        "elements",
        """
, fitted AS (
  SELECT *, greatest(0, least(1, ((1920 - 1600 * s) / 2 + x * s) / 1920)) AS fx, greatest(0, least(1, ((1080 - 1200 * s) / 2 + y * s) / 1080)) AS fy
  FROM (SELECT *, least(1920.0::DOUBLE / 1600, 1080.0::DOUBLE / 1200) AS s FROM elements)
), sized AS (
  SELECT *, greatest(0.02, least(w * s / 1920, 1 - fx)) AS fw, greatest(0.02, least(h * s / 1080, 1 - fy)) AS fh FROM fitted
), around AS (
  SELECT *, greatest(0, fx - 7.0::DOUBLE / 1920) AS ax, greatest(0, fy - 7.0::DOUBLE / 1080) AS ay FROM sized
)
SELECT project_id, page_index, seq, round(ax, 6) AS x, round(ay, 6) AS y, round(least(1, fx + fw + 7.0::DOUBLE / 1920) - ax, 6) AS w,
  round(least(1, fy + fh + 7.0::DOUBLE / 1080) - ay, 6) AS h, round(x - w * 0.08::DOUBLE, 6) AS px, round(w * 1.16::DOUBLE, 6) AS pw, y + h / 2 AS cy
FROM around""",
    ),
}
