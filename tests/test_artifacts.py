"""What a stage made, on a project of golden rows."""

from deckloom.operators import ledger


def test_artifacts_of_each_stage(spark):
    rows = spark.createDataFrame
    tables = {
        "pages": rows([("p", 1, "cover", "a.png", "S"), ("p", 2, "content", None, "")], "project_id string, page_index int, page_type string, image_path string, summary string"),
        "scenes": rows([("p", 1, "s1", 1, "hello", 2.0, None, None, None), ("p", 2, "s2", 2, "", 3.0, "2.wav", "edge", "")], "project_id string, scene_seq int, scene_id string, source_page int, narration string, duration double, audio_path string, provider string, voice string"),
        "actions": rows([("p", "s1", 2, 1.5, "zoom", "e1"), ("p", "s1", 1, 0.5, "reset", None)], "project_id string, scene_id string, action_seq int, at double, type string, target string"),
        "projects": rows([("p", 1.5, "out.mp4")], "project_id string, speech_rate double, output_path string"),
        "timeline": rows([("p", 2, 5, 5.0)], "project_id string, clips int, cues int, duration double"),
        "clips": rows([("p", "s2", "2.mp4"), ("p", "s1", "")], "project_id string, scene_id string, path string"),
        "quality": rows([("p", 87.5)], "project_id string, score double"),
        "findings": rows([("p", 2, "error", "s1", "B"), ("p", 1, "warning", None, "A")], "project_id string, finding_no int, severity string, scene_id string, message string"),
    }
    made = lambda stage: [(r.label, r.kind, r.path or r.text, r.scene_id, r.page) for r in ledger.stage_artifacts(tables, stage).orderBy("index").collect()]
    assert made("parse") == [("第 1 页", "image", "a.png", "", 1)]
    assert made("understand") == [("第 1 页｜cover", "text", "S", "", 1), ("第 2 页｜content", "text", "（无摘要）", "", 2)]
    assert made("narrate") == [("第 1 页讲稿", "text", "hello", "s1", 1), ("第 2 页讲稿", "text", "", "s2", 2)]
    assert made("voice") == [("用的声音", "text", "edge｜引擎默认音色｜语速 1.50×", "", None), ("第 2 页配音（3.0s）", "audio", "2.wav", "s2", 2)]
    assert made("direct") == [("第 1 页镜头", "text", "reset @0.5s；zoom @1.5s → e1", "s1", 1), ("第 2 页镜头", "text", "（这一页没有镜头动作）", "s2", 2)]
    assert made("motion") == [("时间轴", "text", "2 段画面、5 条字幕、共 5.0 秒", "", None)]
    assert made("render") == [("第 2 页片段", "video", "2.mp4", "s2", 2), ("成片", "video", "out.mp4", "", None)]
    assert made("review") == [("质量分 87.5", "text", "[warning] 整体：A\n[error] s1：B", "", None)]
    assert made("upload") == []


def test_lines_of_text_are_moved_once(spark):
    from deckloom.operators import document
    from deckloom.plans import doc_queries, source_queries

    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    made = doc_queries.typed_pages(spark, sf)
    e = doc_queries.elements(spark, sf)
    apart = document.classify_pages(document.page_titles(e).join(document.page_text(e), ["project_id", "page_index"]), e)
    assert sorted(made.collect()) == sorted(apart.select(*made.columns).collect())
    assert plan(made).count("Generate") == 1
    assert not [f for f in source_queries.stage_artifacts(spark, sf).inputFiles() if "documents" in f]
