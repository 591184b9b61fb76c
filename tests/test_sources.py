"""Readers and writers on files, and rules on golden rows."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from deckloom.functions.text import looks_like_bullet, looks_numeric, truncate_clause
from deckloom.operators import charts, document, narration, order_statistics, runs, sessions
from deckloom.schemas import export_schemas
from deckloom.sources import logs


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def run_line(number):
    return json.dumps({"run_id": f"r{number}", "started_at": "2024-01-01T00:00:00Z", "status": "succeeded"})


def test_run_log_passes_over_broken_lines(spark, tmp_path):
    """A log of three lines whose middle one was cut off, and a blank one: they count among the last lines."""
    (tmp_path / "runs.jsonl").write_text(run_line(1) + "\n\n" + run_line(2)[:20] + "\n" + run_line(3) + "\n")
    for limit, want in ((2000, ["r1", "r3"]), (4, ["r1", "r3"]), (3, ["r3"]), (1, ["r3"]), (None, ["r1", "r3"])):
        assert [r.run_id for r in logs.read_runs(spark, str(tmp_path / "runs.jsonl"), limit).collect()] == want


def test_only_the_newest_files_of_a_run_log_are_read(spark, tmp_path):
    number = 0
    for day in range(30):
        folder = tmp_path / "log" / f"day-{day:02d}"
        folder.mkdir(parents=True)
        for part in range(2):
            lines = [run_line(number + k) if (number + k) % 10 else run_line(number + k)[:9] for k in range(50)]
            (folder / f"part-{part}.json").write_text("\n".join(lines) + "\n")
            number += 50
    got = logs.read_runs(spark, str(tmp_path / "log"), 120)
    assert [r.run_id for r in got.collect()] == [f"r{k}" for k in range(number - 120, number) if k % 10]
    assert len(logs.last_lines(spark, str(tmp_path / "log"), 120).inputFiles()) == 4  # of 60: first one, then four
    assert logs.read_runs(spark, str(tmp_path / "log"), 10_000).count() == number * 9 // 10
    (tmp_path / "none").mkdir()
    assert logs.read_runs(spark, str(tmp_path / "none")).count() == 0


def test_no_runs(spark):
    none = spark.createDataFrame([], "status string, duration_s double, quality struct<score:double>")
    assert runs.run_counts(none).first().asDict() == {"runs": 0, "succeeded": 0, "failed": 0}
    assert runs.duration_distribution(none).first().asDict() == {"count": 0, "median": None, "p95": None}


def test_nearest_rank_is_rounded_half_to_even(spark):
    for n, want in ((11, 9.0), (13, 11.0), (30, 27.0), (70, 65.0), (1, 0.0)):
        df = spark.range(n).select(F.col("id").cast("double").alias("v"))
        got = order_statistics.order_statistics(df, [], "v", {"p": order_statistics.nearest_rank_index(0.95)}, cells=7)
        assert got.first().p == want


def test_a_failing_log_write_does_not_reach_the_caller(spark, tmp_path):
    (tmp_path / "file").write_text("in the way")
    assert logs.append_log(spark.range(3), str(tmp_path / "file" / "log")) is False
    assert logs.append_log(spark.range(3), str(tmp_path / "log")) is True and spark.read.json(str(tmp_path / "log")).count() == 3


def test_blank_answers_do_not_fill_a_page(spark):
    page = lambda *rows: spark.createDataFrame([("p", *r) for r in rows], "project_id string, page_index int, narration string")
    got = narration.fill_missing(page((1, ""), (2, ""), (3, "")), page((1, " \n"), (2, "\n said ")), page((3, "kept")), page((1, "fall"), (2, "fall"), (3, "fall")))
    assert sorted((r.page_index, r.narration, r.origin) for r in got.collect()) == [(1, "fall", "fallback"), (2, "said", "answer"), (3, "kept", "kept")]


def test_ledger_turns_and_appends(spark, tmp_path):
    rows = spark.createDataFrame([("p", i, "stage", f"s{i}") for i in range(1, 6)], "project_id string, seq long, kind string, name string")
    logs.append_log(rows.filter("seq < 4"), str(tmp_path / "l"))
    logs.append_log(rows.filter("seq >= 4"), str(tmp_path / "l"))
    assert sorted(r.seq for r in logs.read_ledger(spark, str(tmp_path / "l"), limit=2).collect()) == [4, 5]
    turns = spark.createDataFrame([("a", 1, "user", "x"), ("b", 1, "user", "y")], "project_id string, turn_no int, speaker string, text string")
    logs.overwrite_turns(turns, str(tmp_path / "t"))
    logs.overwrite_turns(turns.filter("project_id = 'b'").withColumn("text", F.lit("z")), str(tmp_path / "t"))
    assert {(r.project_id, r.text) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", "x"), ("b", "z")}


def test_sessions_share_folders_and_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    session = lambda projects, text: projects.selectExpr("cast(id as string) AS project_id", "explode(array(1, 2)) AS turn_no", "'user' AS speaker").withColumn("text", F.lit(text))
    logs.overwrite_turns(session(spark.range(1000, numPartitions=4), "old"), path)
    assert len(list(Path(path).glob("**/*.parquet"))) <= logs.SESSION_FOLDERS
    before = {f for f in Path(path).glob("**/*.parquet")}
    logs.overwrite_turns(session(spark.range(7, 9), "new").filter("project_id = '7' OR turn_no = 2"), path)
    logs.overwrite_turns(session(spark.range(0), "none"), path)
    rows = spark.read.parquet(path)
    want = {(str(k), t): "new" if k in (7, 8) else "old" for k in range(1000) for t in (1, 2) if (k, t) != (8, 1)}
    assert rows.count() == len(want) and {(r.project_id, r.turn_no): r.text for r in rows.collect()} == want
    assert len(before & set(Path(path).glob("**/*.parquet"))) >= len(before) - 2
    assert rows.filter(F.col("folder") == logs.session_folder(F.lit("7"))).filter("project_id = '7'").count() == 2


def test_projects(spark, tmp_path):
    project = {
        "updated_at": "2024-02-01", "status": "done", "source": {"file": "d.pdf"}, "render": {"output_path": "o.mp4"},
        "document": {"title": "T", "pages": [{"page_index": 1, "elements": [{"element_id": "e1", "text": "x"}, {"element_id": "e2", "text": "y"}]}]},
        "scenes": [{"scene_id": "scene_01", "duration": 2.5, "segments": [{"segment_id": "s1", "text": "hi"}], "actions": [{"at": 1.0}]}, {"scene_id": "scene_02", "duration": 3.0}],
    }
    for name, text in (("p1", json.dumps(project)), ("p2", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "project.json").write_text(text)
    projects = logs.read_projects(spark, str(tmp_path))
    row = logs.project_catalog(projects).first()
    assert (row.project_id, row.title, row.file, row.duration, row.output) == ("p1", "T", "d.pdf", 5.5, "o.mp4")
    tables = logs.shred_projects(projects)
    assert {k: v.count() for k, v in tables.items()} == {"pages": 1, "elements": 2, "scenes": 2, "segments": 1, "actions": 1}
    assert [(r.seq, r.element_id) for r in tables["elements"].orderBy("seq").collect()] == [(1, "e1"), (2, "e2")]


def test_admission_and_names(spark, tmp_path):
    for name, size in (("a.PDF", 5), ("b.pptx", 2 << 20), ("c.txt", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r.path.rsplit("/", 1)[1]: (r.type, r.reason) for r in logs.admit_sources(spark, str(tmp_path), max_mb=1).collect()}
    assert got == {"a.PDF": ("pdf", None), "b.pptx": ("pptx", "too large"), "c.txt": (None, "unsupported type")}
    for name, want in (("%E6%8A%A5.pdf", "报.pdf"), ("a+b%20c", "a+b c"), ("100%.pdf", "100%.pdf"), ("plain", "plain"), ("%FF.pdf", "%FF.pdf")):
        assert one(spark, logs.readable_name, name) == want


def test_flags(spark):
    keys = spark.createDataFrame([(f"proj_{i:04d}",) for i in range(1000)], "key string")
    on = {}
    for share in (20, 30, 60):
        flags = spark.createDataFrame([("renderer_remotion", share)], "name string, percent int")
        on[share] = {r.key for r in runs.flag_decisions(keys, flags).filter("enabled").collect()}
    assert 250 < len(on[30]) < 350 and on[20] < on[60]


def test_texts(spark):
    assert one(spark, looks_like_bullet, "  • x") and not one(spark, looks_like_bullet, "x")
    assert one(spark, looks_numeric, " 12.5% ") and not one(spark, looks_numeric, "about 5 things here")
    cut = lambda t, n: one(spark, lambda c: truncate_clause(c, n), t)
    assert cut("营收增长，成本下降，利润为 3,100 万元", 16) == "营收增长，成本下降，"
    assert cut("short", 10) == "short" and cut("abcdef ghijkl", 10) == "abcdef" and cut("abcdefghijklm", 10) == "abcdefghij"
    assert one(spark, narration.sentences, "第一句。第二句！third; 四\n五") == ["第一句。", "第二句！", "third;", "四", "五"]
    assert one(spark, narration.estimate_duration, "") == 0.8
    assert abs(one(spark, narration.estimate_duration, "你好世界。 hello world again") - (4 / 4.6 + 4 / 2.6)) < 1e-9
    assert one(spark, lambda c: narration.trim_to(c, F.lit(8)), "一二三。四五六。七八九。") == "一二三。四五六。"
    numbers = spark.createDataFrame([(0.5,), (1234.0,), (2.25,), (0.0,)], "v double").select(charts.fmt_number(F.col("v")).alias("x")).collect()
    assert [r.x for r in numbers] == ["50%", "1,234", "2.3", "0"] or [r.x for r in numbers] == ["50%", "1,234", "2.2", "0"]


def test_flow_with_a_cycle_keeps_every_node(spark):
    edges = [("p", 1, 1, "a", "b"), ("p", 1, 2, "b", "c"), ("p", 1, 3, "d", "e"), ("p", 1, 4, "e", "d")]
    df = spark.createDataFrame(edges, "project_id string, page_index int, edge_seq int, source string, target string")
    assert [r.node for r in document.flow_order(df).orderBy("place").collect()] == ["a", "b", "c", "d", "e"]


def test_chart_words(spark):
    rows = [("p", "c", 0, i, f"Q{i}", v) for i, v in enumerate((100.0, None, 250.0, 400.0))] + [("p", "c", 1, i, f"Q{i}", v) for i, v in enumerate((100.0, 101.0, 102.0))]
    df = spark.createDataFrame(rows, "project_id string, chart_id string, series_no int, cat_idx int, category string, value double")
    got = {r.series_no: (r.trend, r.change) for r in charts.describe_series(df).collect()}
    assert got == {0: ("up", 300), 1: ("flat", 2)}


def test_sessions_below_the_bound_stay(spark):
    turns = spark.createDataFrame([("a", i, "user", "x" * 10, "") for i in range(12)], "project_id string, turn_no int, speaker string, text string, action string")
    assert sessions.compact(turns).count() == 12
    folded = sessions.compact(turns, above=10).collect()
    assert len(folded) == 9 and [r.action for r in folded if r.speaker == "summary"] == ["compacted:4"]


def test_schemas_are_spark_json():
    assert all(json.loads(x)["type"] == "struct" for x in export_schemas().values())


def test_packed_manifests_take_few_files_and_read_as_folders_do(spark, tmp_path):
    from deckloom.plans import source_queries

    texts = {"a": '{"project_id": "x", "status": "done"}', "b": '{"status": "new"}', "c": '{"status": ', "d": ""}
    for folder, text in texts.items():
        (tmp_path / "folders" / folder).mkdir(parents=True)
        (tmp_path / "folders" / folder / "project.json").write_text(text)
    logs.pack_projects(spark.createDataFrame(list(texts.items()), "folder string, manifest string"), str(tmp_path / "packed"))
    rows = lambda df: sorted((r.project_id, r.status) for r in df.collect())
    got = logs.read_packed_projects(spark, str(tmp_path / "packed"))
    assert rows(got) == rows(logs.read_projects(spark, str(tmp_path / "folders"))) == [("b", "new"), ("x", "done")]
    df = source_queries.projects(spark, "/root/testdata/sf0.01")
    assert df.count() == 1000 and len(df.inputFiles()) <= 100
