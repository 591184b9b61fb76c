"""Queries over listings of projects and artifacts of ledgers, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.operators import ledger, narration, review, views
from deckloom.plans import fixtures
from deckloom.plans.doc_queries import elements, typed_pages
from deckloom.plans.fixtures import with_ctes
from deckloom.plans.narration_queries import budget
from deckloom.plans.narration_queries import segments
from deckloom.plans.review_queries import actions, frames, scenes


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two projects of three."""
    s = scenes(spark, sf_dir)
    scores = s.select("project_id").distinct().filter("cast(project_id as bigint) % 3 <> 0").withColumn("score", F.col("project_id").cast("double"))
    return views.project_summary(s, scores)


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as projects, some without a video or a score; findings are those of blank frames."""
    s, n = scenes(spark, sf_dir).withColumn("duration", F.floor("duration").cast("double")), F.col("doc_id")
    p = fixtures.table(spark, sf_dir, "documents").select(
        n.cast("string").alias("project_id"), F.col("lang").alias("status"), F.format_string("%d.pdf", n).alias("file"), F.col("source").alias("title"),
        (60 + n % 600).cast("int").alias("target"), F.when(n % 4 != 0, F.format_string("%d.mp4", n)).alias("output_path"), F.when(n % 3 != 0, n.cast("double")).alias("score"),
    )
    v = views.project_details(p.drop("score"), s, review.check_blank(frames(scenes(spark, sf_dir))), p)
    return v.withColumns({
        "review": F.transform("review", lambda x: F.concat_ws(":", x["severity"], x["kind"], x["scene_id"])),
        "scenes": F.transform("scenes", lambda x: F.concat_ws(":", x["scene_id"], x["source_page"].cast("string"), x["narration"])),
    })


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.document_view(typed_pages(spark, sf_dir), elements(spark, sf_dir), narration.narration_guide(budget(spark, sf_dir)))
    return v.select("project_id", "page_index", "title", "page_type", F.transform("elements", lambda e: F.concat_ws(":", e["element_id"], e["kind"], e["text"])).alias("elements"), "target_seconds", "chars")


def clip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of the odd pages of two projects of three."""
    s = scenes(spark, sf_dir)
    made = s.filter("source_page % 2 = 1 and cast(project_id as bigint) % 3 <> 0")
    clips = made.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("scene_id", F.concat("project_id", F.lit("/"), "scene_id", F.lit(".mp4"))))).alias("scene_clips"))
    return views.scene_list(s.select("project_id", "scene_id", "source_page", "title", "duration", "narration"), clips)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's project has a scene for every day."""
    r = fixtures.runs(spark, sf_dir)
    return views.run_result(r, r.select("project_id", F.floor("duration_s").alias("duration")))


def overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks of all documents; every third has no score, every fourth no film, every fifth no run; findings of blank frames."""
    s = scenes(spark, sf_dir).withColumn("duration", F.floor("duration").cast("double"))
    n = F.col("doc_id")
    dimensions = F.array(F.struct(F.lit("render").alias("name"), (n % 100).cast("double").alias("score")), F.struct(F.lit("pacing").alias("name"), (n % 50).cast("double").alias("score")))
    found = review.check_blank(frames(s)).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("scene_id", "severity", "message"))).alias("findings"))
    decks = fixtures.table(spark, sf_dir, "documents").select(
        n.cast("string").alias("project_id"), F.col("lang").alias("status"), F.format_string("%d.pdf", n).alias("file"), F.col("source").alias("title"), F.col("lang").alias("topic"), (60 + n % 600).cast("int").alias("target"),
        F.when(n % 4 != 0, F.format_string("%d.mp4", n)).alias("output_path"), F.when(n % 3 != 0, n.cast("double")).alias("score"), dimensions.alias("dimensions"),
        F.when(n % 5 != 0, (n % 90).cast("double")).alias("run_s"), (n % 4).cast("int").alias("degraded"),
    )
    return views.project_overview(s, actions(segments(spark, sf_dir)).withColumn("type", F.lit("zoom")), decks.join(found, "project_id", "left"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step has an artifact for pages 0 to 4, the last of them also for a scene."""
    made = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda p: F.struct(F.when(p == 4, "scene_04").alias("scene_id"), p.alias("page")))
    return ledger.pair_artifacts(fixtures.ledger(spark, sf_dir).withColumn("artifacts", made))


QUERIES = {
    "vw1_summaries": summaries,
    "vw1_details": details,
    "vw2_documents": documents,
    "vw4_scenes": clip_list,
    "vw5_results": results,
    "vw6_overviews": overviews,
    "led3_artifacts": artifacts,
}

SQL = {
    "vw1_summaries": with_ctes(
        "shot",
        """
SELECT project_id, count(*) AS scenes, round(sum(duration), 1) AS duration, project_id::BIGINT % 17 <> 0 AS ready, CASE WHEN project_id::BIGINT % 3 <> 0 THEN project_id::DOUBLE END AS score FROM shot GROUP BY project_id""",
    ),
    "vw1_details": with_ctes(
        "shot blank_found",
        """
SELECT doc_id::VARCHAR AS project_id, lang AS status, doc_id || '.pdf' AS file, source AS title, coalesce(d, 0)::DOUBLE AS duration_s, (60 + doc_id % 600)::INT AS target, coalesce(n, 0) AS scene_count, doc_id % 4 <> 0 AS output_ready,
  CASE WHEN doc_id % 3 <> 0 THEN doc_id::DOUBLE END AS quality, coalesce(f, []) AS review, coalesce(s, []) AS scenes
FROM documents
LEFT JOIN (SELECT project_id, sum(floor(duration)) AS d, count(*) AS n, list(scene_id || ':' || source_page || ':' || narration ORDER BY scene_seq) AS s FROM shot GROUP BY project_id) a ON a.project_id = doc_id::VARCHAR
LEFT JOIN (SELECT project_id, list(severity || ':' || kind || ':' || scene_id ORDER BY kind, scene_id) AS f FROM blank_found GROUP BY project_id) b ON b.project_id = doc_id::VARCHAR""",
    ),
    "vw2_documents": with_ctes(
        "budgets",
        """
SELECT t.project_id, t.page_index, t.title, t.page_type, coalesce(e.elements, []) AS elements, round(b.budget, 1) AS target_seconds, floor(b.budget * 4.6::DOUBLE)::INT AS chars
FROM typed t JOIN budgets b ON b.project_id = t.project_id AND b.page_index = t.page_index
LEFT JOIN (SELECT project_id, page_index, list(element_id || ':' || kind || ':' || text ORDER BY seq) AS elements FROM classified WHERE text <> '' GROUP BY ALL) e ON e.project_id = t.project_id AND e.page_index = t.page_index""",
    ),
    "vw4_scenes": with_ctes(
        "shot",
        """
SELECT project_id, scene_id, source_page, title, duration, narration, CASE WHEN source_page % 2 = 1 AND project_id::BIGINT % 3 <> 0 THEN project_id || '/' || scene_id || '.mp4' END AS clip FROM shot""",
    ),
    "vw5_results": with_ctes(
        "runs",
        """
SELECT r.project_id, r.run_id, r.status, s.stages, r.score AS quality, coalesce(p.n, 0) AS scene_count, p.duration
FROM runs r JOIN (SELECT run_id, list(stage ORDER BY ts, event_id) AS stages FROM stage_events GROUP BY run_id) s USING (run_id)
LEFT JOIN (SELECT project_id, count(*) AS n, sum(floor(duration_s))::BIGINT AS duration FROM runs GROUP BY project_id) p ON p.project_id = r.project_id""",
    ),
    "vw6_overviews": with_ctes(
        "shot segments blank_found",
        """
, told AS (
  SELECT s.project_id, sum(floor(s.duration)) AS seconds,
    string_agg(printf('  %s  p%-3d %6.1fs  动作：%s', s.scene_id, s.source_page, floor(s.duration), coalesce(m, '无')) || chr(10) || '      ' || substr(s.narration, 1, 60), chr(10) ORDER BY s.scene_seq) AS lines
  FROM shot s LEFT JOIN (
    SELECT project_id, printf('scene_%02d', page_index) AS scene_id, string_agg(printf('zoom@%.1fs', seg_seq * 1.5::DOUBLE), '、' ORDER BY seg_seq) AS m FROM segments GROUP BY ALL
  ) a ON a.project_id = s.project_id AND a.scene_id = s.scene_id GROUP BY s.project_id
), blanks AS (
  SELECT f.project_id, string_agg(printf('  [%s] %s %d', f.severity, f.scene_id, length(s.narration) % 120), chr(10) ORDER BY f.scene_id) AS lines
  FROM blank_found f JOIN shot s ON s.project_id = f.project_id AND s.scene_id = f.scene_id GROUP BY f.project_id
)
SELECT doc_id::VARCHAR AS project_id, concat_ws(chr(10),
  printf('工程 %d｜状态 %s｜来源 %d.pdf', doc_id, lang, doc_id), printf('标题：%s｜主题：%s', source, lang), printf('时长：%.1f 秒（目标 %d 秒）', coalesce(seconds, 0)::DOUBLE, 60 + doc_id % 600),
  '成片：' || CASE WHEN doc_id % 4 <> 0 THEN doc_id || '.mp4' ELSE '（未生成）' END,
  CASE WHEN doc_id % 3 <> 0 THEN printf('质量：%.1f 分（render %d｜pacing %d）', doc_id::DOUBLE, doc_id % 100, doc_id % 50) END,
  CASE WHEN doc_id % 5 <> 0 THEN printf('上次运行：%d 秒｜降级 %d 处', doc_id % 90, doc_id % 4) END,
  chr(10) || '场景：' || chr(10) || t.lines, chr(10) || '质检：' || chr(10) || b.lines) AS overview
FROM documents d LEFT JOIN told t ON t.project_id = doc_id::VARCHAR LEFT JOIN blanks b ON b.project_id = doc_id::VARCHAR""",
    ),
    "led3_artifacts": with_ctes(
        "ledger",
        """
SELECT s.project_id, s.seq AS parent, p.page::INT AS index, min(c.seq) AS claimed_by
FROM (SELECT * FROM ledger WHERE kind = 'stage') s CROSS JOIN (SELECT unnest(range(0, 5)) AS page) p
LEFT JOIN ledger c ON c.kind = 'call' AND c.project_id = s.project_id AND c.parent = s.seq AND c.cover = 'page:' || p.page GROUP BY ALL""",
    ),
}
