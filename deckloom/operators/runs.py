"""Run-log analytics: counts, distributions and rollout arms over run records, and feature flags and knobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.operators.order_statistics import distribution


def run_counts(runs: DataFrame) -> DataFrame:
    """RUN-1: one row ``runs, succeeded, failed``; a run that is neither is still going."""
    is_ = lambda s: F.count(F.when(F.col("status") == s, 1))
    return runs.agg(F.count("*").alias("runs"), is_("succeeded").alias("succeeded"), is_("failed").alias("failed"))


def _one_row(spread: DataFrame, name: str) -> DataFrame:
    """The distribution, or a row of count 0 and nulls if there are no values."""
    return spread.agg(
        F.coalesce(F.max("count"), F.lit(0)).cast("long").alias("count"), F.max("median").alias("median"), F.max(name).alias(name)
    )


def duration_distribution(runs: DataFrame) -> DataFrame:
    """RUN-2: ``count, median, p95`` of the durations of succeeded runs, by nearest rank, to 3 decimals."""
    return _one_row(distribution(runs.filter("status = 'succeeded'"), [], "duration_s", 0.95, "p95", 3), "p95")


def quality_distribution(runs: DataFrame) -> DataFrame:
    """RUN-3: ``count, median, p5`` of the scores of succeeded runs: for a score the bad tail is the low one."""
    scored = runs.filter("status = 'succeeded'").select(F.col("quality.score").alias("score"))
    return _one_row(distribution(scored, [], "score", 0.05, "p5", 1), "p5")


def stage_summary(runs: DataFrame) -> DataFrame:
    """RUN-4: ``stage, count, median, p95, failed`` over the stages of all runs."""
    stages = runs.select(F.explode("stages").alias("s")).select("s.stage", "s.duration_s", "s.status")
    failed = stages.groupBy("stage").agg(F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))
    return distribution(stages, ["stage"], "duration_s", 0.95, "p95", 3).join(failed, "stage")


def degradation_counts(runs: DataFrame) -> DataFrame:
    """RUN-5: ``what, n``, most frequent first."""
    what = runs.select(F.explode("degradations").alias("d")).select("d.what")
    return what.groupBy("what").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "what")


def flag_arms(runs: DataFrame) -> DataFrame:
    """RUN-6: ``flag, arm, runs, quality_median, duration_s_median`` of succeeded runs; arm is on or off."""
    kept = runs.filter("status = 'succeeded'").select(F.explode("flags").alias("flag", "value"), "duration_s", "quality.score")
    kept = kept.withColumn("arm", F.when(F.col("value"), "on").otherwise("off"))
    keys = ["flag", "arm"]
    n = kept.groupBy(*keys).agg(F.count("*").alias("runs"))
    score = distribution(kept, keys, "score", 0.5, "p", 1).select(*keys, F.col("median").alias("quality_median"))
    seconds = distribution(kept, keys, "duration_s", 0.5, "p", 2).select(*keys, F.col("median").alias("duration_s_median"))
    return n.join(score, keys, "left").join(seconds, keys, "left")


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """RUN-7: the newest runs, projected for a listing."""
    newest = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)
    return newest.select("run_id", "project_id", "started_at", "duration_s", "status", F.col("quality.score").alias("score"))


def arm_report(arms: DataFrame, flags: DataFrame) -> DataFrame:
    """RUN-8: the arms with the flag's current share; a flag that is no longer declared is retired."""
    shares = flags.select(F.col("name").alias("flag"), F.col("percent"))
    return arms.join(shares, "flag", "left").withColumn("retired", F.col("percent").isNull())


def normalize_runs(runs: DataFrame) -> DataFrame:
    """RUN-9: cut stage details and reasons to 200 characters and errors to 400."""
    stages = F.transform("stages", lambda s: s.withField("detail", F.substring(s["detail"], 1, 200)))
    reasons = F.transform("degradations", lambda d: d.withField("reason", F.substring(d["reason"], 1, 200)))
    return runs.withColumns({"stages": stages, "degradations": reasons, "error": F.substring("error", 1, 400)})


def bucket(name: Column, key: Column) -> Column:
    """FLG-1: 0..99 from the first 8 hex digits of the SHA-256 of ``name:key``."""
    digest = F.sha2(F.concat(name, F.lit(":"), key), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100).cast("int")


def rollout_percent(flags: DataFrame, overrides: DataFrame) -> DataFrame:
    """FLG-2: ``name, description, percent``: the override or default, clamped to 0..100; an unknown flag is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown flag: "), F.col("name"))).cast("int")
    both = flags.join(overrides.select("name", F.col("percent").alias("__set")), "name", "full")
    share = F.when(F.col("default_percent").isNull(), unknown).otherwise(F.coalesce("__set", "default_percent"))
    return both.select("name", "description", F.greatest(F.lit(0), F.least(F.lit(100), share)).alias("percent"))


def flag_decisions(keys: DataFrame, flags: DataFrame) -> DataFrame:
    """FLG-3, one row for each key and flag: ``key, name, enabled``. The declared flags are a handful and broadcast."""
    shares = flags.select("name", "percent").agg(F.collect_list(F.struct("name", "percent")).alias("__flags"))
    pairs = keys.select("key").join(F.broadcast(shares)).select("key", F.explode("__flags").alias("f"))
    return pairs.select("key", "f.name", (bucket(F.col("f.name"), F.col("key")) < F.col("f.percent")).alias("enabled"))


def active_flags(keys: DataFrame, flags: DataFrame) -> DataFrame:
    """FLG-3: ``key, flags``, every flag's decision as a map, as a run records it."""
    shares = flags.select("name", "percent").agg(F.collect_list(F.struct("name", "percent")).alias("__flags"))
    pairs = keys.select("key").join(F.broadcast(shares))
    entry = F.transform("__flags", lambda f: F.struct(f["name"], bucket(f["name"], F.col("key")) < f["percent"]))
    return pairs.select("key", F.map_from_entries(entry).alias("flags"))


def choose_arm(keys: DataFrame, adapters: DataFrame, flag_name: str, percent: int) -> DataFrame:
    """FLG-4: ``key, arm, reason``. An explicit preference wins; ``auto`` goes by the rollout, then by the order of adapters.

    ``adapters`` are ``name, position, available, behind_flag`` (a handful); ``keys`` have ``key, preference``. A preference
    that is unknown or not available is an error, never replaced by another arm, and so is ``auto`` without an arm: then the
    arm is null and the reason says why.
    """
    listed = adapters.agg(F.array_sort(F.collect_list(F.struct("position", "name", "behind_flag", "available"))).alias("__arms"))
    rows = keys.join(F.broadcast(listed)).withColumn("__on", bucket(F.lit(flag_name), F.col("key")) < percent)
    wanted = F.filter("__arms", lambda a: a["name"] == F.col("preference"))
    ruled = F.filter("__arms", lambda a: a["available"] & (F.col("__on") | ~a["behind_flag"]))
    asked = F.col("preference") != "auto"
    chosen = F.when(asked, F.filter(wanted, lambda a: a["available"])).otherwise(ruled)
    reason = F.when(F.size(chosen) > 0, None).when(~asked, "no arm is available").when(F.size(wanted) > 0, "not available").otherwise("unknown")
    return rows.select("key", F.get(chosen, F.lit(0))["name"].alias("arm"), reason.alias("reason"))


def knob_values(knobs: DataFrame, prefs: DataFrame, prefix: str = "") -> DataFrame:
    """TUN-1: ``scope, id, value, overridden`` for every scope and knob: the clamped override, or the default."""
    wanted = knobs.filter(F.col("id").startswith(prefix))
    set_ = prefs.select("scope", "id", F.col("value").alias("__set"))
    listed = wanted.agg(F.collect_list(F.struct("id", "default", "low", "high", "integer")).alias("__knobs"))
    pairs = prefs.select("scope").distinct().join(F.broadcast(listed)).select("scope", F.explode("__knobs").alias("k"))
    rows = pairs.select("scope", "k.*").join(set_, ["scope", "id"], "left")
    value = F.coalesce(F.greatest("low", F.least("high", "__set")), F.col("default"))
    value = F.when(F.col("integer"), F.bround(value, 0)).otherwise(value)
    return rows.select("scope", "id", value.alias("value"), F.col("__set").isNotNull().alias("overridden"))


def apply_overrides(prefs: DataFrame, changes: DataFrame) -> DataFrame:
    """TUN-2: set or clear; a change to null takes the override away, so the default holds again."""
    new = changes.select("scope", "id", F.col("value").alias("__new"), F.lit(True).alias("__changed"))
    both = prefs.select("scope", "id", F.col("value").alias("__old")).join(new, ["scope", "id"], "full")
    value = F.when(F.col("__changed"), F.col("__new")).otherwise(F.col("__old"))
    return both.select("scope", "id", value.alias("value")).filter("value is not null")


# Knob id, default, low, high, whole numbers only.
KNOBS = (
    ("voice.unit_seconds", 9.0, 3.0, 20.0, False),
    ("voice.lead", 1.1, 0.0, 2.0, False),
    ("voice.tail", 1.0, 0.0, 2.0, False),
    ("voice.pause_sentence", 0.75, 0.0, 1.5, False),
    ("voice.pause_emphasis", 1.2, 0.0, 2.0, False),
    ("voice.pause_turn", 0.95, 0.0, 2.0, False),
    ("shot.max_zoom_chars", 40.0, 10.0, 200.0, True),
    ("shot.max_scale", 3.0, 1.2, 6.0, False),
    ("shot.min_result", 0.05, 0.0, 0.5, False),
    ("review.too_fast", 340.0, 200.0, 600.0, False),
    ("review.too_slow", 180.0, 60.0, 300.0, False),
    ("review.monotone_seconds", 12.0, 4.0, 40.0, False),
    ("review.still_enough", 6.0, 1.0, 30.0, False),
    ("review.action_change", 8.0, 1.0, 40.0, False),
)


def knob_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOBS), "id string, default double, low double, high double, integer boolean")
