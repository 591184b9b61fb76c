"""Joins of times by buckets, and state that is kept from run to run."""

import random

from deckloom.functions.intervals import meet
from deckloom.operators import captions, narration, shots
from pyspark.sql import functions as F

PLAN = "project_id string, scene_id string, fingerprint string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_meet_the_spans_around_them_once(spark):
    rng = random.Random(1)
    spans = [(k % 2, i, s := round(rng.uniform(-50, 4000), 2), round(s + rng.choice([0.0, 0.5, 8.0, 30.0, 900.0, 5000.0]), 2)) for i, k in enumerate(rng.choices(range(2), k=300))]
    points = [(k % 3, i, round(rng.uniform(-60, 9000), 2)) for i, k in enumerate(rng.choices(range(3), k=300))] + [(0, 300, spans[0][2]), (1, 301, spans[0][3])]
    s = spark.createDataFrame([*spans, (0, -1, None, 3.0), (0, -2, 5.0, 4.0)], "k int, s int, a double, b double")
    p = spark.createDataFrame([*points, (0, 999, None)], "k int, p int, t double")
    got = meet(p, s, ["k"], "t", "a", "b").filter("a <= t AND t < b").select("p", "s").collect()
    want = [(i, j) for k, i, t in points for k2, j, a, b in spans if k == k2 and a <= t < b]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_scene_of_20_000_captions_and_pauses(spark):
    n = 20_000
    cues = spark.range(n).select(F.format_string("p%d", F.col("id") % 1).alias("project_id"), (F.col("id") % 1 + 1).cast("int").alias("page_index"), F.col("id").cast("int").alias("seg_seq"), F.lit(1).alias("cue_seq"), (F.col("id") * 3.0).alias("start"), (F.col("id") * 3.0 + 3).alias("end"), F.lit("some words here").alias("text"))
    pauses = spark.range(n).select(F.format_string("p%d", F.col("id") % 1).alias("project_id"), (F.col("id") % 1 + 1).cast("int").alias("page_index"), (F.col("id") * 3.0 + 1.75).alias("end"), F.lit(0.5).alias("duration"))
    cut = captions.split_at_pauses(cues, pauses)
    assert "CartesianProduct" not in plan_of(cut) and "NestedLoopJoin" not in plan_of(cut) and "__bucket" in plan_of(cut)
    assert cut.count() == 2 * n
    zoom = pauses.select("project_id", "page_index", F.lit("zoom").alias("type"), (F.col("end") - 1.75).alias("start"), (F.col("end") - 0.1).alias("end"), F.struct(F.col("end").alias("x")).alias("area"))
    on = shots.active_zoom(cues, zoom)
    assert "__bucket" in plan_of(on)
    assert on.agg(F.count("*"), F.sum(F.col("area.x") - 3 * F.col("seg_seq"))).first() == (n, 1.75 * n)


def test_the_second_run_renders_nothing(spark, tmp_path):
    table = shots.fingerprint_table(spark, str(tmp_path / "t"))
    plans = lambda **marks: spark.createDataFrame([(k[0], k[1:], v) for k, v in marks.items()], PLAN)
    run = lambda number, renderer="r", **marks: sorted((x.project_id + x.scene_id, x.reason) for x in shots.render_run(plans(**marks), table, number, renderer).collect())
    assert run(1, a1="x", a2="y", b1="z") == [("a1", "no clips"), ("a2", "no clips"), ("b1", "no clips")]
    assert run(2, a1="x", a2="y", b1="z") == []
    assert run(3, a1="x", a2="Y", a3="w") == [("a2", "changed"), ("a3", "new")]
    assert run(3, a1="x", a2="Y", a3="w") == [("a2", "changed"), ("a3", "new")]  # the run is tried again
    assert run(4, a1="x", b1="z") == []  # b's last run was the second
    assert run(5, a1="x", a2="Y") == [("a2", "new")]  # the fourth run had it no more
    assert run(6, "other", a1="x", a2="Y") == [("a1", "renderer"), ("a2", "renderer")]


def test_the_second_run_records_nothing_but_what_got_lost(spark, tmp_path):
    table = narration.voice_table(spark, str(tmp_path / "t"))
    scenes = spark.createDataFrame([("a", "1", "x", "1.wav"), ("a", "2", "y", None)], PLAN + ", path string")
    run = lambda number, s, **more: sorted((x.scene_id, x.reason) for x in narration.voice_run(s, table, number, **more).collect())
    assert run(0, scenes) == [("1", "new"), ("2", "new")]
    assert run(1, scenes) == [("2", "missing")]
    assert run(2, scenes.withColumn("fingerprint", F.lit("z"))) == [("1", "changed"), ("2", "missing")]
    assert run(3, scenes.withColumn("fingerprint", F.lit("z")), force=True) == [("1", "forced"), ("2", "forced")]
