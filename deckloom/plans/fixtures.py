"""The library's tables derived from the tables at hand, in Spark and as SQL for DuckDB.

``CTES`` holds the SQL twin of each mapping; ``with_ctes`` puts those that a query needs before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.operators.runs import bucket
from deckloom.sources.logs import deck_from_text

FLAG = "renderer_remotion"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a stage of the run of its user and day."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(
        F.concat(F.lit("proj_"), F.col("user_id").cast("string")).alias("project_id"),
        F.concat_ws("_", F.lit("run"), F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        "event_id",
        "ts",
        F.col("event_type").alias("stage"),
        F.col("value").alias("duration_s"),
        F.when(F.col("k") >= 90, "failed").otherwise("done").alias("status"),
        "k",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records: a run fails with any of its stages; k from 80 to 89 is a degradation; the mean k is the score."""
    e = stage_events(spark, sf_dir)
    by_time = lambda *cols: F.array_sort(F.collect_list(F.struct("ts", "event_id", *cols)))
    degraded = F.filter("__s", lambda s: (s["k"] >= 80) & (s["k"] < 90))
    r = e.groupBy("project_id", "run_id").agg(by_time("stage", "duration_s", "status", "k").alias("__s"), F.avg("k").alias("__q"))
    seconds = F.aggregate("__s", F.lit(0.0), lambda t, s: t + s["duration_s"])
    failed = F.exists("__s", lambda s: s["status"] == "failed")
    stage = lambda s: F.struct(s["stage"].alias("stage"), s["duration_s"].alias("duration_s"), s["status"].alias("status"), F.lit(None).cast("string").alias("detail"))
    what = lambda s: F.struct(s["stage"].alias("what"), F.lit(None).cast("string").alias("reason"))
    score = F.when(F.size("__s") > 1, F.col("__q"))
    return r.select(
        "project_id",
        "run_id",
        F.get("__s", F.lit(0))["ts"].alias("started_at"),
        F.round(seconds, 2).alias("duration_s"),
        F.when(failed, "failed").otherwise("succeeded").alias("status"),
        F.transform("__s", stage).alias("stages"),
        F.transform(degraded, what).alias("degradations"),
        F.create_map(F.lit(FLAG), bucket(F.lit(FLAG), F.col("project_id")) < 50).alias("flags"),
        F.when(F.size("__s") > 1, F.struct(score.alias("score"))).alias("quality"),
        F.lit(None).cast("string").alias("error"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    role = F.col("role")
    speaker = F.when(role == "user", "user").when(role == "assistant", "agent").otherwise("tool")
    return c.select(
        F.col("conv_id").cast("string").alias("project_id"),
        F.col("turn").cast("int").alias("turn_no"),
        speaker.alias("speaker"),
        "text",
        F.when(speaker == "tool", "render").otherwise("").alias("action"),
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as elements: eight to a page, in boxes below each other, with sizes by their length."""
    rows = deck_from_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    return rows.select(
        F.col("doc_id").cast("string").alias("project_id"),
        "page_index",
        "seq",
        F.format_string("p%02d_e%02d", "page_index", "seq").alias("element_id"),
        "text",
        (10 + n % 7).cast("double").alias("font_size"),
        F.lit(80.0).alias("x"),
        (60.0 + 110.0 * (F.col("seq") - 1)).alias("y"),
        F.least(F.lit(1760.0), 12.0 * n).alias("w"),
        F.lit(80.0).alias("h"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger entries of a user's day: k below 30, or the first, is a step; others are calls under the latest step."""
    e = stage_events(spark, sf_dir)
    order = Window.partitionBy("run_id").orderBy("ts", "event_id")
    rows = e.withColumn("seq", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("kind", F.when((F.col("k") < 30) | (F.col("seq") == 1), "stage").otherwise("call"))
    step = F.last(F.when(F.col("kind") == "stage", F.col("seq")), ignorenulls=True).over(order)
    return rows.select(
        F.col("run_id").alias("project_id"),
        "seq",
        "kind",
        F.col("stage").alias("name"),
        F.when(F.col("kind") == "call", step).alias("parent"),
        "status",
        "duration_s",
        F.array(F.concat(F.lit("page:"), (F.col("k") % 5).cast("string"))).alias("covers"),
        F.col("k"),
        F.col("project_id").alias("run_id"),
        F.col("ts").alias("at"),
    )


CTES = {
    "stage_events": """
SELECT 'proj_' || user_id AS project_id, 'run_' || user_id || '_' || strftime(ts, '%Y%m%d') AS run_id, event_id, ts,
  event_type AS stage, value AS duration_s, CASE WHEN k >= 90 THEN 'failed' ELSE 'done' END AS status, k
FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events)
""",
    "runs": """
SELECT project_id, run_id, min(ts) AS started_at, round(sum(duration_s), 2) AS duration_s,
  CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN count(*) > 1 THEN avg(k) END AS score,
  ('0x' || substr(sha256('renderer_remotion:' || project_id), 1, 8))::BIGINT % 100 < 50 AS flag
FROM stage_events GROUP BY project_id, run_id
""",
    "turns": """
SELECT conv_id::VARCHAR AS project_id, turn::INT AS turn_no,
  CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'agent' ELSE 'tool' END AS speaker, text,
  CASE WHEN role IN ('user', 'assistant') THEN '' ELSE 'render' END AS action
FROM conversations
""",
    "elements": """
SELECT doc_id::VARCHAR AS project_id, ((i - 1) // 8 + 1)::INT AS page_index, ((i - 1) % 8 + 1)::INT AS seq,
  printf('p%02d_e%02d', ((i - 1) // 8 + 1)::INT, ((i - 1) % 8 + 1)::INT) AS element_id, text,
  (10 + length(text) % 7)::DOUBLE AS font_size, 80.0::DOUBLE AS x,
  (60 + 110 * ((i - 1) % 8))::DOUBLE AS y, least(1760, 12 * length(text))::DOUBLE AS w, 80.0::DOUBLE AS h
FROM (
  SELECT doc_id, lines[i] AS text, i
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x : x <> '') AS lines FROM documents))
)
""",
    "ledger": """
SELECT run_id AS project_id, seq, kind, stage AS name,
  CASE WHEN kind = 'call' THEN max(CASE WHEN kind = 'stage' THEN seq END) OVER (PARTITION BY run_id ORDER BY seq) END AS parent,
  status, duration_s, 'page:' || (k % 5) AS cover, k, project_id AS run_id, ts AS at
FROM (
  SELECT *, CASE WHEN k < 30 OR seq = 1 THEN 'stage' ELSE 'call' END AS kind
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq FROM stage_events)
)
""",
}
NEEDS = {"runs": ["stage_events"], "ledger": ["stage_events"]}


def with_ctes(names: str, body: str) -> str:
    """The query with the named mappings, and those that they need, before it."""
    found: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in found:
            found.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in found) + "\n" + body.strip()
