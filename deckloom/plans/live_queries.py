"""Queries over streams, messages and views, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.operators import catalog_index, intent, views
from deckloom.plans import fixtures
from deckloom.plans.doc_queries import typed_pages
from deckloom.plans.fixtures import with_ctes
from deckloom.plans.review_queries import scenes
from deckloom.plans.run_queries import SQL as RUN_SQL
from deckloom.sources.shared import shared_path
from deckloom.streaming import jobs


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events: a user's day is a job; k under 2 ends it well, over 97 badly."""
    e = fixtures.stage_events(spark, sf_dir)
    status = F.when(F.col("k") < 2, "succeeded").when(F.col("k") > 97, "failed").otherwise("running")
    return e.select(F.col("project_id").alias("job_id"), "event_id", "ts", status.alias("status"), "stage", F.col("k").alias("done"), F.lit(100).alias("total"))


def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events go through a stream, slice by slice in time; then the table of states is read."""
    e = job_events(spark, sf_dir)
    events = jobs.as_stream(e, "job-events", jobs.time_slices(e, "ts"))
    table = jobs.job_table(spark, shared_path(spark, "job-table"))
    jobs.follow_jobs(events, table, shared_path(spark, "job-checkpoint"), keep="90 days", delay="30 days")
    return jobs.known_jobs(table).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs go through a stream; then the table of counts is read."""
    r = fixtures.runs(spark, sf_dir).select("run_id", "status", "stages", "degradations")
    table = jobs.count_table(spark, shared_path(spark, "count-table"))
    jobs.follow_runs(jobs.as_stream(r, "runs"), table, shared_path(spark, "count-checkpoint"))
    return jobs.merged_counts(table.rows())


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = run_counts(spark, sf_dir).filter("kind <> 'run'")
    n = lambda kind, what: F.sum(F.when(F.col("kind") == kind, F.col(what)).otherwise(0))
    return c.groupBy(F.col("name").alias("stage")).agg(n("stage", "n").alias("count"), n("stage", "failed").alias("failed"), n("degradation", "n").alias("degraded"))


def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.list_jobs(jobs.job_state(job_events(spark, sf_dir)), 20)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.table(spark, sf_dir, "pages")
    return p.select(
        F.col("page_id").alias("key"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), (F.col("page_id") % 10 == 0).alias("installed")
    )


def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wishes from a document's length and the numbers in its text, for a deck of a page for each line break."""
    d = fixtures.table(spark, sf_dir, "documents")
    named = F.transform(F.regexp_extract_all("text", F.lit("[0-9]{1,3}"), F.lit(0)), lambda x: x.cast("int"))
    pages = (F.length("text") - F.length(F.translate("text", "\n", ""))).cast("int")
    rows = d.select(F.col("doc_id").cast("int").alias("doc_id"), F.col("n_chars").cast("int").alias("duration"), named.alias("emphasis_pages"), F.array((F.col("n_chars") % 50).cast("int")).alias("skip_pages"), pages.alias("page_count"))
    return intent.sanitize_intent(rows)


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and source, against the same with some fields set anew."""
    d = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("project_id"), F.col("lang").alias("language"), F.col("source").alias("voice"), F.col("n_chars").alias("duration"))
    fields = ("language", "voice", "duration")
    n = F.col("project_id").cast("int")
    new = d.withColumns({"voice": F.when(n % 3 == 0, "v2").otherwise(F.col("voice")), "duration": F.when(n % 5 == 0, F.lit(None)).otherwise(F.col("duration"))})
    return intent.intent_diff(d, new, fields)


def indexed(spark: SparkSession, sf_dir: str, fields: list[str]) -> tuple[catalog_index.Index, DataFrame]:
    c = catalog(spark, sf_dir)
    return catalog_index.build_index(c, fields, "key", shared_path(spark, "catalog-index")), c


QUERIES = {
    "vw7_indexed": lambda spark, sf_dir: catalog_index.indexed_search(*indexed(spark, sf_dir, ["title", "lang"]), "THE ion en"),
    "vw9_indexed": lambda spark, sf_dir: catalog_index.indexed_facets(*indexed(spark, sf_dir, ["title"]), "tion e", "lang"),
    "str1_job_state": job_state,
    "str2_run_counters": counters,
    "str2_run_totals": lambda spark, sf_dir: jobs.totals(run_counts(spark, sf_dir)),
    "str2_stage_summary": lambda spark, sf_dir: jobs.stage_summary(run_counts(spark, sf_dir)),
    "str2_degradations": lambda spark, sf_dir: jobs.degradations(run_counts(spark, sf_dir)),
    "str3_newest_jobs": newest_jobs,
    "int6_sanitize": sanitize,
    "int8_diff": diff,
    "vw3_page_views": lambda spark, sf_dir: views.page_views(typed_pages(spark, sf_dir), scenes(spark, sf_dir)),
    "vw7_search": lambda spark, sf_dir: views.catalog_search(catalog(spark, sf_dir), "the EN", ["title", "lang"], "key"),
    "vw9_entries": lambda spark, sf_dir: views.faceted_entries(catalog(spark, sf_dir), "e", ["title"], "lang", "en"),
    "vw9_facets": lambda spark, sf_dir: views.faceted_search(catalog(spark, sf_dir), "e", ["title"], "lang"),
}

_STATE = """
SELECT job_id, status, stage, done, total, updated_at
FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ended DESC, CASE WHEN ended THEN epoch_us(updated_at) ELSE -epoch_us(updated_at) END, CASE WHEN ended THEN event_id ELSE -event_id END) AS r
  FROM (
    SELECT project_id AS job_id, event_id, ts AS updated_at, CASE WHEN k < 2 THEN 'succeeded' WHEN k > 97 THEN 'failed' ELSE 'running' END AS status,
      stage, k AS done, 100 AS total, k < 2 OR k > 97 AS ended
    FROM stage_events
  )
) WHERE r = 1
"""
_CATALOG = """
SELECT page_id AS key, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, page_id % 10 = 0 AS installed FROM pages
"""
SQL = {
    "vw7_indexed": f"""
SELECT key, title, lang, installed, total, matched
FROM (SELECT *, count(*) OVER () AS total, count(*) FILTER (hit) OVER () AS matched
  FROM (SELECT *, contains(lower(title || chr(10) || lang), 'the') AND contains(lower(title || chr(10) || lang), 'ion') AND contains(lower(title || chr(10) || lang), 'en') AS hit FROM ({_CATALOG})))
WHERE hit ORDER BY installed DESC, key LIMIT 20
""",
    "vw9_indexed": f"SELECT lang, count(*) AS n FROM ({_CATALOG}) WHERE contains(lower(title), 'tion') AND contains(lower(title), 'e') GROUP BY lang",
    "str1_job_state": with_ctes("stage_events", _STATE),
    "str2_run_counters": with_ctes(
        "stage_events",
        "SELECT stage, count(*) AS count, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (k >= 80 AND k < 90) AS degraded FROM stage_events GROUP BY stage",
    ),
    "str2_run_totals": with_ctes("runs", "SELECT count(*) AS runs, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed FROM runs"),
    "str2_stage_summary": RUN_SQL["run4_stage_summary"],
    "str2_degradations": RUN_SQL["run5_degradations"],
    "str3_newest_jobs": with_ctes("stage_events", f"SELECT * FROM ({_STATE}) ORDER BY updated_at DESC, job_id LIMIT 20"),
    "int6_sanitize": r"""
SELECT doc_id::INT AS doc_id, greatest(15, least(7200, n_chars))::INT AS duration,
  list_sort(list_distinct(list_filter(named, lambda x : x >= 1 AND x <= top))) AS emphasis_pages,
  list_filter([n_chars % 50], lambda x : x >= 1 AND x <= top) AS skip_pages, page_count
FROM (SELECT *, CASE WHEN page_count > 0 THEN page_count ELSE 9999 END AS top FROM (
  SELECT *, list_transform(regexp_extract_all(text, '[0-9]{1,3}'), lambda x : x::INT) AS named, (length(text) - length(replace(text, chr(10), '')))::INT AS page_count FROM documents))
""",
    "int8_diff": """
SELECT doc_id::VARCHAR AS project_id, list_concat(CASE WHEN v THEN ['voice'] ELSE [] END, CASE WHEN d THEN ['duration'] ELSE [] END) AS changed, v AND NOT d AS sound_only
FROM (SELECT doc_id, doc_id % 3 = 0 AND source IS DISTINCT FROM 'v2' AS v, doc_id % 5 = 0 AND n_chars IS NOT NULL AS d FROM documents)
""",
    "vw3_page_views": with_ctes(
        "shot",
        """
SELECT t.project_id, t.page_index, t.title, t.page_type, s.scene_id, coalesce(s.narration, '') AS narration
FROM typed t LEFT JOIN shot s ON s.project_id = t.project_id AND s.source_page = t.page_index""",
    ),
    "vw7_search": f"""
SELECT key, title, lang, installed, total, matched
FROM (SELECT *, count(*) OVER () AS total, count(*) FILTER (hit) OVER () AS matched
  FROM (SELECT *, contains(lower(title || chr(10) || lang), 'the') AND contains(lower(title || chr(10) || lang), 'en') AS hit FROM ({_CATALOG})))
WHERE hit ORDER BY installed DESC, key LIMIT 20
""",
    "vw9_entries": f"SELECT * FROM ({_CATALOG}) WHERE contains(lower(title), 'e') AND lang = 'en'",
    "vw9_facets": f"SELECT lang, count(*) AS n FROM ({_CATALOG}) WHERE contains(lower(title), 'e') GROUP BY lang",
}
