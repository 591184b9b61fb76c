"""Queries over run logs, flags, knobs, sessions and logs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.operators import order_statistics, runs, sessions
from deckloom.plans import fixtures
from deckloom.plans.fixtures import with_ctes
from deckloom.sources import logs


def _runs(f):
    return lambda spark, sf_dir: f(fixtures.runs(spark, sf_dir))


def _turns(f):
    return lambda spark, sf_dir: f(fixtures.turns(spark, sf_dir))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.stage_events(spark, sf_dir).select(F.col("project_id").alias("key")).distinct()


def _flags(spark: SparkSession) -> DataFrame:
    rows = [("renderer_remotion", "new renderer", 50), ("fast_voice", "quicker voices", 10)]
    return spark.createDataFrame(rows, "name string, description string, default_percent int")


def _shares(spark: SparkSession) -> DataFrame:
    overrides = spark.createDataFrame([("fast_voice", 130), ("renderer_remotion", 30)], "name string, percent int")
    return runs.rollout_percent(_flags(spark), overrides)


def flag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many projects each flag is on for, beside its configured share."""
    on = runs.flag_decisions(_keys(spark, sf_dir), _shares(spark))
    counted = on.groupBy("name").agg(F.count("*").alias("keys"), F.count(F.when(F.col("enabled"), 1)).alias("enabled"))
    return counted.join(_shares(spark), "name").select("name", "description", "percent", "keys", "enabled")


def active_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.active_flags(_keys(spark, sf_dir), _shares(spark))
    return found.select("key", F.col("flags")["renderer_remotion"].alias("renderer"), F.col("flags")["fast_voice"].alias("voice"))


def choose_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("remotion", 1, True, True), ("ffmpeg", 2, True, False), ("video", 3, False, False)]
    adapters = spark.createDataFrame(rows, "name string, position int, available boolean, behind_flag boolean")
    wanted = F.when(F.col("key").endswith("7"), "ffmpeg").when(F.col("key").endswith("3"), "video").when(F.col("key").endswith("5"), "none").otherwise("auto")
    return runs.choose_arm(_keys(spark, sf_dir).withColumn("preference", wanted), adapters, "renderer_remotion", 30)


def arm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = _shares(spark).filter("name <> 'renderer_remotion'")
    return runs.arm_report(runs.flag_arms(fixtures.runs(spark, sf_dir)), shares.select("name", "percent"))


def _prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last 20 of a kind of knob by the events: scope is the project, the value goes past the bounds at times."""
    e = fixtures.stage_events(spark, sf_dir).groupBy("project_id", "k").agg(F.max("duration_s").alias("value"))
    names = F.array(*[F.lit(k[0]) for k in runs.KNOBS])
    e = e.select(F.col("project_id").alias("scope"), F.get(names, F.col("k") % len(runs.KNOBS)).alias("id"), "value").groupBy("scope", "id").agg(F.max("value").alias("value"))
    return e


def knob_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.knob_values(runs.knob_table(spark), _prefs(spark, sf_dir), "voice.")


def apply_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefs = _prefs(spark, sf_dir)
    changes = prefs.filter("value > 20").select("scope", "id", F.when(F.col("value") < 60, F.col("value") / 2).alias("value"))
    return runs.apply_overrides(prefs, changes)


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records with long texts put in from the stage names, and cut."""
    r = fixtures.runs(spark, sf_dir)
    r = r.withColumn("stages", F.transform("stages", lambda s: s.withField("detail", F.repeat(s["stage"], 60))))
    r = r.withColumn("degradations", F.transform("degradations", lambda d: d.withField("reason", F.repeat(d["what"], 50))))
    r = runs.normalize_runs(r.withColumn("error", F.when(F.col("status") == "failed", F.repeat("run_id", 40))))
    size = lambda c, f: F.aggregate(c, F.lit(0), lambda t, x: t + F.length(x[f]))
    return r.select("run_id", size("stages", "detail").alias("details"), size("degradations", "reason").alias("reasons"), F.length("error").alias("error_chars"))


def rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of stage durations by project and stage."""
    e = fixtures.stage_events(spark, sf_dir)
    ranks = {"p5": order_statistics.nearest_rank_index(0.05), "p95": order_statistics.nearest_rank_index(0.95)}
    return order_statistics.order_statistics(e, ["stage", "status"], "duration_s", ranks)


def assign_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number even turns on from the odd ones stored."""
    t = fixtures.turns(spark, sf_dir)
    stored = t.filter("turn_no % 2 = 1").select("project_id", F.col("turn_no").cast("long").alias("seq"))
    return logs.assign_seq(t.filter("turn_no % 2 = 0").select("project_id", "turn_no"), stored, ["turn_no"])


def deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.deck_from_text(fixtures.table(spark, sf_dir, "documents"))


QUERIES = {
    "run1_counts": _runs(runs.run_counts),
    "run2_durations": _runs(runs.duration_distribution),
    "run2_nearest_rank": rank_check,
    "run3_quality": _runs(runs.quality_distribution),
    "run4_stage_summary": _runs(runs.stage_summary),
    "run5_degradations": _runs(runs.degradation_counts),
    "run6_flag_arms": _runs(runs.flag_arms),
    "run7_recent": _runs(runs.recent_runs),
    "run8_arm_report": arm_report,
    "run9_normalize": normalize,
    "flg1_buckets": lambda spark, sf_dir: _keys(spark, sf_dir).withColumn("bucket", runs.bucket(F.lit("fast_voice"), F.col("key"))),
    "flg2_flg4_report": flag_report,
    "flg3_active_flags": active_flags,
    "flg4_choose_arm": choose_arm,
    "tun1_knob_values": knob_values,
    "tun2_overrides": apply_overrides,
    "ses1_cost": _turns(sessions.session_cost),
    "ses2_recent": _turns(lambda t: sessions.recent_turns(t, 3)),
    "ses3_compact": _turns(lambda t: sessions.compact(t, above=400, keep=2)),
    "ses4_digest": _turns(sessions.digest),
    "src3_compactions": _turns(lambda t: logs.compactions(sessions.compact(t, above=400, keep=2))),
    "src8_deck": deck,
    "snk3_assign_seq": assign_seq,
}

_SPREAD = """
SELECT {keys} count(*) AS count, round(quantile_cont({v}, 0.5), {digits}) AS median,
  round(list_sort(list({v}))[(greatest(0, least(count(*) - 1, round_even({p} * count(*), 0)::BIGINT - 1)) + 1)::BIGINT], {digits}) AS {name}
"""
_DURATIONS = _SPREAD.format(keys="", v="duration_s", p=0.95, name="p95", digits=3)
_SHARES = """
shares AS (SELECT * FROM (VALUES ('renderer_remotion', 'new renderer', 30), ('fast_voice', 'quicker voices', 100)) t(name, description, percent)),
keys AS (SELECT DISTINCT project_id AS key FROM stage_events),
buckets AS (SELECT key, name, percent, ('0x' || substr(sha256(name || ':' || key), 1, 8))::BIGINT % 100 AS bucket FROM keys, shares)
"""
_KNOBS = "knobs AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{k}', {d}::DOUBLE, {lo}::DOUBLE, {hi}::DOUBLE)" for i, (k, d, lo, hi, _) in enumerate(runs.KNOBS)
) + ') t(place, id, "default", low, high))'
_PREFS = """
prefs AS (
  SELECT project_id AS scope, knobs.id, max(duration_s) AS value
  FROM stage_events JOIN knobs ON k % 14 = place GROUP BY project_id, knobs.id
)
"""


def _more(names: str, extra: str, body: str) -> str:
    """Mappings, then further ones written out, then the query."""
    return with_ctes(names, "").rstrip() + ",\n" + extra.strip() + "\n" + body.strip()


_FOLDED = """
costs AS (SELECT project_id, count(*) AS turns, sum(greatest(1, length(text) // 2 + length(action) // 2)) AS cost FROM turns GROUP BY project_id),
ranked AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.project_id ORDER BY turn_no DESC) > 2 AND c.cost > 400 AND c.turns > 2 AS old
  FROM turns t JOIN costs c USING (project_id)
),
asks AS (
  SELECT project_id, count(*) AS folded, coalesce(array_to_string((list(substr(text, 1, 60) ORDER BY turn_no) FILTER (speaker = 'user'))[1:6], '；'), '') AS asks
  FROM ranked WHERE old GROUP BY project_id
),
folded AS (
  SELECT project_id, turn_no, speaker, text, action FROM ranked WHERE NOT old
  UNION ALL
  SELECT project_id, 0, 'summary', '（早先的 ' || folded || ' 轮已折叠）用户先后提过：' || CASE WHEN asks = '' THEN '（没有明确要求）' ELSE asks END,
    'compacted:' || folded FROM asks
)
"""

SQL = {
    "run1_counts": with_ctes("runs", "SELECT count(*) AS runs, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed FROM runs"),
    "run2_durations": with_ctes("runs", _DURATIONS + "FROM runs WHERE status = 'succeeded'"),
    "run2_nearest_rank": with_ctes(
        "stage_events",
        """
SELECT stage, status, count(*) AS n,
  list_sort(list(duration_s))[(greatest(0, least(count(*) - 1, round_even(0.05 * count(*), 0)::BIGINT - 1)) + 1)::BIGINT] AS p5,
  list_sort(list(duration_s))[(greatest(0, least(count(*) - 1, round_even(0.95 * count(*), 0)::BIGINT - 1)) + 1)::BIGINT] AS p95
FROM stage_events GROUP BY stage, status""",
    ),
    "run3_quality": with_ctes("runs", _SPREAD.format(keys="", v="score", p=0.05, name="p5", digits=1) + "FROM runs WHERE status = 'succeeded' AND score IS NOT NULL"),
    "run4_stage_summary": with_ctes(
        "stage_events",
        _SPREAD.format(keys="stage,", v="duration_s", p=0.95, name="p95", digits=3)
        + ", count(*) FILTER (status = 'failed') AS failed FROM stage_events GROUP BY stage",
    ),
    "run5_degradations": with_ctes("stage_events", "SELECT stage AS what, count(*) AS n FROM stage_events WHERE k >= 80 AND k < 90 GROUP BY stage"),
    "run6_flag_arms": with_ctes(
        "runs",
        """
SELECT 'renderer_remotion' AS flag, CASE WHEN flag THEN 'on' ELSE 'off' END AS arm, count(*) AS runs,
  round(quantile_cont(score, 0.5), 1) AS quality_median, round(quantile_cont(duration_s, 0.5), 2) AS duration_s_median
FROM runs WHERE status = 'succeeded' GROUP BY runs.flag""",
    ),
    "run7_recent": with_ctes("runs", "SELECT run_id, project_id, started_at, duration_s, status, score FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 20"),
    "run8_arm_report": with_ctes(
        "runs",
        """
SELECT 'renderer_remotion' AS flag, CASE WHEN flag THEN 'on' ELSE 'off' END AS arm, count(*) AS runs,
  round(quantile_cont(score, 0.5), 1) AS quality_median, round(quantile_cont(duration_s, 0.5), 2) AS duration_s_median,
  NULL::INT AS percent, true AS retired
FROM runs WHERE status = 'succeeded' GROUP BY runs.flag""",
    ),
    "run9_normalize": with_ctes(
        "stage_events",
        """
SELECT run_id, sum(least(200, 60 * length(stage))) AS details,
  coalesce(sum(least(200, 50 * length(stage))) FILTER (k >= 80 AND k < 90), 0) AS reasons,
  CASE WHEN bool_or(status = 'failed') THEN least(400, 40 * length(run_id)) END AS error_chars
FROM stage_events GROUP BY run_id""",
    ),
    "flg1_buckets": with_ctes(
        "stage_events",
        "SELECT key, (('0x' || substr(sha256('fast_voice:' || key), 1, 8))::BIGINT % 100)::INT AS bucket FROM (SELECT DISTINCT project_id AS key FROM stage_events)",
    ),
    "flg2_flg4_report": _more(
        "stage_events",
        _SHARES,
        """
SELECT name, description, s.percent, count(*) AS keys, count(*) FILTER (bucket < s.percent) AS enabled
FROM buckets JOIN shares s USING (name) GROUP BY name, description, s.percent""",
    ),
    "flg3_active_flags": _more(
        "stage_events",
        _SHARES,
        """
SELECT key, bool_or(bucket < percent) FILTER (name = 'renderer_remotion') AS renderer,
  bool_or(bucket < percent) FILTER (name = 'fast_voice') AS voice
FROM buckets GROUP BY key""",
    ),
    "flg4_choose_arm": _more(
        "stage_events",
        _SHARES,
        """
SELECT key, CASE WHEN key LIKE '%7' THEN 'ffmpeg' WHEN key LIKE '%3' OR key LIKE '%5' THEN NULL WHEN bucket < 30 THEN 'remotion' ELSE 'ffmpeg' END AS arm,
  CASE WHEN key LIKE '%3' THEN 'not available' WHEN key LIKE '%5' THEN 'unknown' END AS reason
FROM buckets WHERE name = 'renderer_remotion'""",
    ),
    "tun1_knob_values": _more(
        "stage_events",
        _KNOBS + "," + _PREFS,
        """
SELECT s.scope, k.id, coalesce(greatest(k.low, least(k.high, p.value)), k."default") AS value, p.value IS NOT NULL AS overridden
FROM (SELECT DISTINCT scope FROM prefs) s, knobs k LEFT JOIN prefs p ON p.scope = s.scope AND p.id = k.id
WHERE k.id LIKE 'voice.%'""",
    ),
    "tun2_overrides": _more(
        "stage_events",
        _KNOBS + "," + _PREFS,
        "SELECT scope, id, CASE WHEN value > 20 THEN value / 2 ELSE value END AS value FROM prefs WHERE value < 60",
    ),
    "ses1_cost": with_ctes(
        "turns",
        "SELECT project_id, count(*) AS turns, sum(greatest(1, length(text) // 2 + length(action) // 2)) AS cost FROM turns GROUP BY project_id",
    ),
    "ses2_recent": with_ctes("turns", "SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY turn_no DESC) <= 3"),
    "ses3_compact": _more("turns", _FOLDED, "SELECT * FROM folded"),
    "ses4_digest": with_ctes(
        "turns",
        """
SELECT project_id, count(*) AS folded,
  coalesce(array_to_string((list(substr(text, 1, 60) ORDER BY turn_no) FILTER (speaker = 'user'))[1:6], '；'), '') AS asks
FROM turns GROUP BY project_id""",
    ),
    "src3_compactions": _more("turns", _FOLDED, "SELECT project_id, count(*) FILTER (speaker = 'summary') AS compacted FROM folded GROUP BY project_id"),
    "src8_deck": with_ctes("elements", "SELECT project_id::BIGINT AS doc_id, page_index, seq, text FROM elements"),
    "snk3_assign_seq": with_ctes(
        "turns",
        """
SELECT e.project_id, e.turn_no, coalesce(o.last, 0) + row_number() OVER (PARTITION BY e.project_id ORDER BY e.turn_no) AS seq
FROM turns e LEFT JOIN (SELECT project_id, max(turn_no) AS last FROM turns WHERE turn_no % 2 = 1 GROUP BY project_id) o USING (project_id)
WHERE e.turn_no % 2 = 0""",
    ),
}
