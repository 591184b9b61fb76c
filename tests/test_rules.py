"""Rules on golden rows, with Chinese text that the tables at hand don't have."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from deckloom.functions.text import stripped
from deckloom.operators import attention, captions, document, drafts, intent, narration, review
from deckloom.plans import review_queries, shot_queries


def test_pages_and_readings(spark):
    df = spark.createDataFrame([("第 3 页和第7页，第3页", "K8s 念 K eights，RAG读作R A G，K8s 读成 kates，API 念 阿派"), ("第7~5页", "没有")], "a string, b string")
    rows = df.select(intent.page_mentions(F.col("a")).alias("p"), intent.pronunciations(F.col("b")).alias("m")).collect()
    assert [r.p for r in rows] == [[3, 7], []]
    assert rows[0].m == {"K8s": "kates", "RAG": "R A G"} and rows[1].m == {}


def test_sound_only_changes(spark):
    schema = "project_id string, voice string, duration int"
    old = spark.createDataFrame([("a", "v1", 60), ("b", "v1", 60), ("c", "v1", None)], schema)
    new = spark.createDataFrame([("a", "v2", 60), ("b", "v2", 90), ("c", "v1", None)], schema)
    got = {r.project_id: (r.changed, r.sound_only) for r in intent.intent_diff(old, new, ("voice", "duration")).collect()}
    assert got == {"a": (["voice"], True), "b": (["voice", "duration"], False), "c": ([], False)}


def test_pointing(spark):
    rows = [("chart", ""), ("paragraph", "目录"), ("paragraph", "12%"), ("paragraph", "架构图"), ("paragraph", "x")]
    df = spark.createDataFrame(rows, "kind string, text string").select(attention.worth_pointing_at().alias("x"))
    assert [r.x for r in df.collect()] == [True, False, False, True, False]
    n = spark.createDataFrame([(3.0,), (15.0,), (21.0,), (300.0,)], "s double").select(attention.action_budget(F.col("s")).alias("n"))
    assert [r.n for r in n.collect()] == [2, 2, 4, 8]


def test_caption_box(spark):
    df = spark.createDataFrame([("字" * 10,), ("字" * 80,)], "t string").select(review.subtitle_box(F.col("t")).alias("b"))
    short, long = [r.b for r in df.collect()]
    assert (short.w, short.h) == (456.0, 82.0) and (long.w, long.h) == (1536.0, 190.0)


def test_clean_project_scores_over_90(spark):
    scenes = spark.createDataFrame([("p", f"scene_{i:02d}", i, 1) for i in range(1, 6)], "project_id string, scene_id string, source_page int, actions int")
    pages = spark.createDataFrame([("p", i, "content") for i in range(1, 6)], "project_id string, page_index int, page_type string")
    none = spark.createDataFrame([], "project_id string, severity string, kind string, scene_id string, message string")
    cues = scenes.select("project_id", "scene_id")
    assert review.score_quality(none, scenes, pages, cues).first().score == 100.0
    bad = spark.createDataFrame([("p", "error", "missing_audio", "scene_01", "")], none.schema)
    assert review.score_quality(bad, scenes, pages, cues).first().completeness == 80.0


def greedy(pages, budgets, target, pace, silence, marks):
    def trim(text, limit):
        parts, at = [], 0
        for i, c in enumerate(text):
            if c in marks:
                parts.append(text[at : i + 1])
                at = i + 1
        parts.append(text[at:])
        parts = [p for p in parts if p.strip()]
        if len(text) <= limit or len(parts) <= 1:
            return text
        kept = parts[0]
        for p in parts[1:]:
            if len(kept) + len(p) > limit:
                break
            kept += p
        return kept

    total = sum(len(t) / pace for t in pages.values()) + silence * len(pages)
    over = sorted(((len(t) / pace - budgets[i]) * (0.4 if i % 5 == 0 else 1.0), i) for i, t in pages.items() if len(t) / pace > budgets[i])
    out = dict(pages)
    for _, i in reversed(over):
        if total <= target * 1.1:
            break
        shorter = trim(pages[i], int(budgets[i] * pace))
        if len(shorter) < len(pages[i]):
            total -= (len(pages[i]) - len(shorter)) / pace
            out[i] = shorter
    return out


def test_fitting_is_the_greedy_loop(spark):
    rng = random.Random(9)
    drafts, budgets, intents, want = [], [], [], {}
    for p in range(12):
        pages = {i: "".join("字" * rng.randrange(3, 30) + "。" for _ in range(rng.randrange(1, 9))) for i in range(1, rng.randrange(3, 12))}
        shares = {i: float(rng.randrange(5, 25)) for i in pages}
        target = rng.randrange(20, 200)
        drafts += [(f"p{p}", i, t, False) for i, t in pages.items()]
        budgets += [(f"p{p}", i, b) for i, b in shares.items()]
        intents.append((f"p{p}", target, [5, 10]))
        want |= {(f"p{p}", i): t for i, t in greedy(pages, shares, target, 4.6, 2.1, "。！？").items()}
    got = narration.fit_duration(
        spark.createDataFrame(drafts, "project_id string, page_index int, narration string, frozen boolean"),
        spark.createDataFrame(budgets, "project_id string, page_index int, budget double"),
        spark.createDataFrame(intents, "project_id string, duration int, emphasis_pages array<int>"),
    )
    assert {(r.project_id, r.page_index): r.narration for r in got.collect()} == want


def rows_of(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def kinds(found):
    return sorted((r.severity, r.kind) for r in found.collect())


CUE = "project_id string, scene_id string, cue_seq int, start double, end double, text string, page_index int"
ELEMENT = "project_id string, page_index int, element_id string, label string, text string, x double, y double, w double, h double, page_w double, page_h double, importance double"
ZOOM = "project_id string, scene_id string, cue_seq int, area struct<x:double,y:double,w:double,h:double>"


def test_captions_over_elements(spark):
    """An element under the caption, one far above it, a footer of no importance, and one that a zoom has moved out of the frame."""
    cue = rows_of(spark, CUE, ("p", "scene_01", 1, 0.0, 8.0, "一句普通长度的中文字幕", 1))
    tall = rows_of(spark, CUE, ("p", "scene_01", 1, 0.0, 8.0, "很长的一句话，" * 60, 1))
    element = lambda y, importance=0.8: rows_of(spark, ELEMENT, ("p", 1, "e1", "16+数据来源", "16+数据来源", 700.0, y, 400.0, 60.0, 1920.0, 1080.0, importance))
    none, quarter = rows_of(spark, ZOOM), rows_of(spark, ZOOM, ("p", "scene_01", 1, (0.0, 0.0, 0.4, 0.4)))
    assert kinds(review.check_caption_cover(cue, element(1000.0), none)) == [("warning", "subtitle_cover")]
    for e, zooms in ((element(200.0), none), (element(1000.0, 0.2), none), (element(1000.0), quarter)):
        assert kinds(review.check_caption_cover(cue, e, zooms)) == []
    # 16 px of padding above the text are part of the box: an element that reaches under it by a quarter is covered
    top = 1080 * 0.97 - 82
    assert kinds(review.check_caption_cover(cue, element(top - 44.0), none)) == [("warning", "subtitle_cover")]
    assert kinds(review.check_caption_cover(cue, element(top - 46.0), none)) == []
    assert kinds(review.check_caption_overflow(tall)) == [("error", "subtitle_overflow")]
    assert kinds(review.check_caption_overflow(cue)) == [] and kinds(review.check_caption_cover(tall, element(1000.0), none)) == []


def test_targets_that_are_missing_are_errors(spark):
    action = rows_of(spark, "project_id string, scene_id string, source_page int, target string", ("p", "s1", 1, "gone"), ("p", "s1", 1, ""), ("p", "s1", 1, None), ("p", "s1", 1, "e1"), ("p", "s1", 1, "Label"))
    element = rows_of(spark, "project_id string, page_index int, element_id string, label string", ("p", 1, "e1", "Label"))
    assert [(r.severity, r.message) for r in review.check_dangling(action, element).collect()] == [("error", "gone")]


def test_pairs_of_characters_keep_white_space(spark):
    scene = rows_of(spark, "project_id string, scene_id string, source_page int, narration string", ("p", "s1", 1, "a b\nc"), ("p", "s2", 2, "abc"))
    page = rows_of(spark, "project_id string, page_index int, raw_text string", ("p", 1, "abc"), ("p", 2, "ab c abc"))
    assert [r.scene_id for r in review.check_read_aloud(scene, page).collect()] == ["s2"]
    pairs = spark.createDataFrame([("a \n b",)], "t string").select(review.bigrams(F.col("t")).alias("x")).first().x
    assert sorted(pairs) == sorted(["a ", " \n", "\n ", " b"])


def test_only_scenes_that_are_heard_are_rated(spark):
    schema = "project_id string, scene_id string, page_index int, narration string, audio_path string, audio_duration double, duration double"
    said = "字" * 100
    scenes = rows_of(
        spark, schema, ("p", "fast", 1, said, "a.wav", 12.1, 90.0), ("p", "slow", 2, said[:20], "b.wav", 12.1, 1.0), ("p", "silent", 3, "", "c.wav", 12.1, 12.1),
        ("p", "none", 4, said, None, 12.1, 12.1), ("p", "gone", 5, said, "d.wav", 12.1, 12.1), ("p", "short", 6, said, "e.wav", 4.0, 40.0), ("p", "fine", 7, said[:45], "f.wav", 12.1, 12.1),
    )
    held = rows_of(spark, "path string", *[(f"{c}.wav",) for c in "abcef"])
    assert sorted((r.scene_id, r.message) for r in review.check_rate(scenes, held).collect()) == [("fast", "fast"), ("slow", "slow")]
    unbroken = scenes.select("project_id", "page_index", F.lit(13.0).alias("longest"))
    assert sorted(r.scene_id for r in review.check_monotone(unbroken, scenes, held).collect()) == ["scene_01", "scene_02", "scene_07"]


def test_errors_and_warnings_are_counted_as_the_rules_say(spark):
    found = rows_of(spark, "project_id string, severity string, kind string, scene_id string, message string", ("p", "error", "dangling_action", "s", ""), ("p", "error", "subtitle_overflow", "s", ""), ("p", "warning", "pacing", "s", ""))
    scenes = rows_of(spark, "project_id string, scene_id string, source_page int, actions int", ("p", "s", 1, 1))
    pages = rows_of(spark, "project_id string, page_index int, page_type string", ("p", 1, "content"))
    row = review.score_quality(found, scenes, pages, scenes.select("project_id")).first()
    assert (row.errors, row.warnings, row.direction, row.subtitles, row.pacing) == (2, 1, 85.0, 0.0, 90.0)


def test_trends(spark):
    from deckloom.operators import charts

    series = {1: [100.0, 400.0], 2: [100.0, 101.0, 102.0], 3: [100.0, 180.0, 101.0], 4: [100.0, 180.0, 120.0], 5: [7.0], 6: [0.0, 9.0, 5.0], 7: [400.0, 100.0]}
    rows = [("p", "c", s, i, str(i), v) for s, values in series.items() for i, v in enumerate(values)]
    got = charts.describe_series(rows_of(spark, "project_id string, chart_id string, series_no int, cat_idx int, category string, value double", *rows))
    assert {r.series_no: (r.trend, r.change, r.peak) for r in got.collect()} == {
        1: ("up", 300, None), 2: ("flat", 2, None), 3: ("flat", 1, None), 4: ("up", 20, 180.0), 5: (None, None, None), 6: ("changed", None, 9.0), 7: ("down", -75, None),
    }


def test_page_furniture_and_banners(spark):
    rows = [("paragraph", "1", "T", False, False), ("paragraph", "·", "T", False, False), ("paragraph", "CONTENTS", "T", False, False), ("paragraph", "Agenda:", "T", False, False),
            ("paragraph", " ·目录、", "T", False, False), ("paragraph", "16+ 数据来源", "T", True, False), ("chart", "", "", True, False), ("image", None, None, True, False),
            ("title", "任何文字", "T", True, True), ("subtitle", " 供应链情报 ", "供应链情报", True, True), ("subtitle", "", "", False, False)]
    df = spark.createDataFrame(rows, "kind string, text string, title string, a boolean, b boolean")
    got = df.select("a", "b", attention.worth_pointing_at().alias("able"), attention.is_banner().alias("banner")).collect()
    assert [(r.able, r.banner) for r in got] == [r[3:] for r in rows]


def page_of(spark, elements, sentences):
    e = [("p", 1, i, f"e{i}", label, kind, text, importance, "The title") for i, (label, kind, text, importance) in enumerate(elements, 1)]
    s = [("p", 1, i, text, refs) for i, (text, refs) in enumerate(sentences, 1)]
    df = rows_of(spark, "project_id string, page_index int, seq int, element_id string, label string, kind string, text string, importance double, title string", *e)
    said = rows_of(spark, "project_id string, page_index int, seg_seq int, text string, element_refs array<string>", *s)
    return df, said


def test_what_sentences_point_at(spark):
    elements = [
        ("head", "title", "Deckwide", 0.9), ("same", "subtitle", "The title", 0.8), ("pic", "image", "", 0.4), ("dup", "paragraph", "1", 0.5), ("dup", "paragraph", "Revenue by quarter", 0.5),
        (None, "bullet", "Cost", 0.6), (None, "bullet", "Revenue by year", 0.7),
    ]
    sentences = [
        ("nothing", ["e1", "pic"]),  # a heading is passed over, a picture without words isn't one
        ("nothing", ["dup"]),  # a label means its first element, which can't be pointed at
        ("Our Revenue grew", []), ("the Cost of it", ["none"]), ("so The title says", []), ("and Deckwide", []), ("Rev", []), ("", []),
    ]
    got = {r.seg_seq: r.element_id for r in attention.resolve_targets(*reversed(page_of(spark, elements, sentences))).collect()}
    assert got == {1: "e3", 3: "e7", 4: "e6", 5: "e2"}


def test_a_long_page_has_no_product_of_sentences_and_elements(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(5000)]
    elements = [(None, "bullet", w, 0.5) for w in words]
    sentences = [(f"about {words[(i * 7) % 5000]} here", []) for i in range(5000)]
    df, said = page_of(spark, elements, sentences)
    got = attention.resolve_targets(said, df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and not re.search(r"(?<!array_)contains\(", plan.lower())
    found = {r.seg_seq: int(r.element_id[1:]) for r in got.collect()}
    first = {}
    for i, w in enumerate(words, 1):
        first.setdefault(w[:6], i)
    assert all(found[i + 1] <= (i * 7) % 5000 + 1 for i in range(5000)) and len(found) == 5000
    assert sum(found[i + 1] == first[words[(i * 7) % 5000][:6]] for i in range(5000)) > 4990


def test_an_arm_that_is_asked_for_is_never_replaced(spark):
    from deckloom.operators import runs

    arms = rows_of(spark, "name string, position int, available boolean, behind_flag boolean", ("new", 1, True, True), ("old", 2, True, False), ("video", 3, False, False))
    keys = rows_of(spark, "key string, preference string", ("a", "new"), ("b", "video"), ("c", "film"), ("d", "auto"))
    got = lambda adapters, percent: {r.key: (r.arm, r.reason) for r in runs.choose_arm(keys, adapters, "f", percent).collect()}
    assert got(arms, 0) == {"a": ("new", None), "b": (None, "not available"), "c": (None, "unknown"), "d": ("old", None)}
    assert got(arms, 100)["d"] == ("new", None)
    assert got(arms.filter("name <> 'old'"), 0)["d"] == (None, "no arm is available")


def test_pages_that_messages_name(spark):
    rows = {
        "第5~8页重点讲，关键数据出现时放大": [5, 6, 7, 8], "第3页和第 12 頁": [3, 12], "第5~6页，第9页": [5, 6], "第8到6页": [], "tel 030-99999999999": [],
        "第 99999999999 页": [], "第1到20000000页": list(range(1, 10_000)), "2024-2026": [], "ids 1-20000000": [], "2至4页": [2, 3, 4], "": [], None: [],
    }
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r.p for r in df.select(intent.page_mentions(F.col("t")).alias("p")).collect()] == list(rows.values())
    assert df.select(intent.page_mentions(F.col("t"), 7).alias("p")).first().p == [5, 6, 7]


MESSAGE = "project_id string, message_id int, text string"
NOW = "project_id string, style string, tone string, audience string, speech_rate double, duration int, emphasis_pages array<int>"


def test_wishes_of_messages(spark):
    said = ["帮我生成一个8分钟的产品讲解视频，面向企业客户，专业一点", "第5~8页重点讲，关键数据出现时放大", "再短一点吧", "详细讲第 3 页", "第 3 页"]
    now = rows_of(spark, NOW, ("p", "tech", "旧", "投资人", 1.0, 300, [9]))
    got = intent.parse_intent(rows_of(spark, MESSAGE, *[("p", i, t) for i, t in enumerate(said)]), now).collect()
    r = {x.message_id: x for x in got}
    assert (r[0].duration, r[0].audience, r[0].style, r[0].tone) == (480, "企业客户", "professional", "清晰、稳重")
    assert (r[1].emphasis_pages, r[1].zoom_on_key_data) == ([5, 6, 7, 8, 9], True)
    assert (r[2].duration, r[2].audience, r[2].style, r[2].emphasis_pages) == (300, "投资人", "tech", [9])
    assert (r[3].emphasis_pages, r[4].emphasis_pages) == ([3, 9], [9])


def test_edits_of_messages(spark):
    scenes = rows_of(spark, "project_id string, source_page int, scene_id string", ("p", 1, "scene_01"), ("p", 7, "scene_07"))
    now = rows_of(spark, NOW, ("p", "tech", "", "", 1.0, 480, None))
    said = ["第7页太长了，压缩到20秒", "压缩到6分钟", "声音更年轻一些", "所有关键数字都放大", "第 99999999999 页 20 秒", "第7页改成 1 分 5 秒"]
    r = {x.message_id: x for x in intent.parse_edits(rows_of(spark, MESSAGE, *[("p", i, t) for i, t in enumerate(said)]), scenes, now).collect()}
    assert (r[0].scene_ids, r[0].target_seconds, r[0].duration) == (["scene_07"], 20.0, 480)
    assert (r[1].scene_ids, r[1].duration) == ([], 360)
    assert r[2].revoice and not r[2].redirect and r[3].redirect
    assert (r[4].scene_ids, r[4].duration) == ([], 480) and r[5].target_seconds == 65.0


def test_lengths_of_messages(spark):
    rows = {"7分钟": 420.0, "七分钟": 420.0, "5 分 30 秒": 330.0, "一个小时半": 5400.0, "半小时": 1800.0, "十二分半": 750.0, "半分钟": 30.0, "45秒": 45.0, "没有": None}
    df = spark.createDataFrame([(t,) for t in rows], "t string").select(intent.stated_duration(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == list(rows.values())


def test_axes_of_charts(spark):
    from deckloom.operators import charts

    schema = "project_id string, chart_id string, series_no int, cat_idx int, value double, stacked boolean, secondary boolean"
    rows = [("p", "a", 1, 0, 30.0, True, False), ("p", "a", 2, 0, 45.0, True, None), ("p", "a", 3, 0, 0.4, False, True), ("p", "b", 1, 0, 7.0, False, True), ("p", "c", 1, 0, None, False, False), ("p", "d", 1, 0, -3.0, False, False)]
    declared = rows_of(spark, "project_id string, chart_id string, y_min double, y_max double, y2_min double, y2_max double", ("p", "d", -10.0, 10.0, None, None), ("p", "b", None, None, None, 50.0))
    points = rows_of(spark, schema, *rows)
    got = lambda *more: {(r.chart_id, r.axis): (r.low, r.high, r.step) for r in charts.axis_scale(points, *more).collect()}
    assert got(4, declared) == {
        ("a", "primary"): (0.0, 80.0, 20.0), ("a", "secondary"): (0.0, 0.4, 0.2), ("b", "primary"): (0.0, 8.0, 2.0), ("b", "secondary"): (0.0, 60.0, 20.0), ("c", "primary"): (0.0, 1.0, 0.5),
        ("d", "primary"): (-10.0, 10.0, 10.0),
    }
    assert got()["d", "primary"] == (-3.0, 0.0, 1.0)
    assert ("d", "secondary") not in got()


def test_guide_rounds_doubles_as_they_are_and_budgets_do_not_hang_on_the_order_of_rows(spark):
    """26.249999999999996 and the silence are 28.349999999999998: times ten that is 283.5, though its decimal digits say less."""
    b = spark.createDataFrame([("p", 1, 26.249999999999996)], "project_id string, page_index int, budget double")
    got = narration.narration_guide(b).first()
    assert (got.target_seconds, got.chars, got.page_seconds) == (26.2, 120, 28.4)
    rows = [("p", i, t, "x" * (7 * i * i % 600)) for i, t in enumerate(["cover", "content", "chart", "content", "summary", "architecture", "content", "agenda"], 1)]
    intents = spark.createDataFrame([("p", 100, [5])], "project_id string, duration int, emphasis_pages array<int>")
    budgets = set()
    for turn in range(6):
        pages = spark.createDataFrame(rows[turn:] + rows[:turn], "project_id string, page_index int, page_type string, raw_text string").coalesce(1)
        budgets.add(tuple(r.budget for r in narration.allocate_budget(pages, intents).orderBy("page_index").collect()))
    assert len(budgets) == 1


def test_rhythm_of_a_long_scene_is_told_in_one_pass(spark):
    """40 000 sentences in one scene: the text was split anew for each of them."""
    rows = [("p", "long", "一二三四五。" * 40_000), ("p", "mixed", "一。一二三四五六七八九十。一二。一二三四五六七。"), ("p", "few", "一二。一二。一二。")]
    s = spark.createDataFrame(rows, "project_id string, scene_id string, narration string")
    began = time.monotonic()
    got = [(r.scene_id, r.message) for r in review.check_rhythm(s).collect()]
    assert got == [("long", "40000 sentences alike")] and time.monotonic() - began < 60


def test_few_beginnings_are_looked_for_without_a_row_for_each_character(spark, monkeypatch):
    """A page with few elements never takes its sentences apart; one with many does, with the same targets."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gam", "delta x", "ep", "zetaeta"]
    said = [" ".join(rng.choices(words, k=6)) for _ in range(40)]
    elements = [(f"e{i}", i, rng.choice(["title", "bullet"]), rng.choice([0.5, 0.9]), t) for i, t in enumerate(words * 3, 1)]
    df = spark.createDataFrame([("p", 1, *e, e[0], "no title") for e in elements], "project_id string, page_index int, element_id string, seq int, kind string, importance double, text string, label string, title string")
    s = spark.createDataFrame([("p", 1, i, t, []) for i, t in enumerate(said)], "project_id string, page_index int, seg_seq int, text string, element_refs array<string>")
    got = lambda: sorted(map(tuple, attention.resolve_targets(s, df).collect()))
    with monkeypatch.context() as patched:
        patched.setattr(attention, "windows", lambda text, size: F.array(F.raise_error(F.lit("taken apart"))).cast("array<string>"))
        few = got()
    monkeypatch.setattr(attention, "FEW", 0, raising=False)
    assert few and few == got()


def test_pages_go_to_be_walked_many_at_a_time(spark):
    """Each page was a group of its own in pandas; nodes on cycles still come last, as declared."""
    from deckloom.operators import document

    arrows = [("p", 1, 1, "b", "c"), ("p", 1, 2, "a", "b"), ("p", 1, 3, "a", "c"), ("p", 2, 1, "x", "y"), ("p", 2, 2, "y", "x"), ("p", 2, 3, "s", "t"), ("p", 2, 4, "s", "t")]
    got = document.flow_order(spark.createDataFrame(arrows, "project_id string, page_index int, edge_seq int, source string, target string"))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {}
    for r in got.orderBy("page_index", "place").collect():
        rows.setdefault(r.page_index, []).append((r.place, r.node))
    assert rows == {1: [(1, "a"), (2, "b"), (3, "c")], 2: [(1, "s"), (2, "t"), (3, "x"), (4, "y")]}


def test_ends_of_texts_are_stripped_of_white_space_of_any_script_without_a_pattern(spark):
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in every], "c string").withColumn("t", F.concat("c", F.lit("a\u3000b"), "c"))
    assert rows.filter(stripped(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    assert "regexp" not in rows.select(stripped(F.col("t")))._jdf.queryExecution().analyzed().toString().lower()


def test_lengths_and_pages_are_read_from_messages_with_a_long_run_of_digits(spark):
    """A number's pattern begins anew at each digit of the run; over 300,000 of them that took hours."""
    rows = spark.createDataFrame([("5 分 30 秒，第 3 页，" + "7" * 300_000,), ("第2~3页 十二分半" + "8" * 300_000 + "y",), ("9" * 300_000,)], "text string")
    got = rows.select(intent.stated_duration(F.col("text")).alias("s"), intent.page_mentions(F.col("text")).alias("p")).collect()
    assert [tuple(r) for r in got] == [(330.0, [3]), (750.0, [2, 3]), (None, [])]


def test_boundaries_are_matched_in_rows_of_many_scenes(spark):
    expected = spark.createDataFrame([("p", 1, 1, 1.0), ("p", 1, 2, 2.0), ("p", 2, 1, 1.0), ("q", 1, 1, 5.0), ("q", 1, 2, 6.0)], "project_id string, page_index int, seg_seq int, expected double")
    pauses = spark.createDataFrame([("p", 1, 2.1, 0.2), ("p", 1, 1.1, 0.2), ("p", 1, 9.0, 0.2), ("p", 2, 1.5, 0.0), ("p", 2, 0.5, 0.0), ("q", 1, 5.0, 0.2)], "project_id string, page_index int, end double, duration double")
    got = captions.match_boundaries(expected, pauses)
    assert sorted(tuple(r) for r in got.collect()) == [("p", 1, 1, 1.0), ("p", 1, 2, 2.0), ("p", 2, 1, 0.5)]
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()


def test_captions_are_cut_once_for_a_row(spark):
    """A generator works its columns out wherever they stand: a sentence was cut into captions twice."""
    rows = spark.createDataFrame([("p", 1, 1, "One, two; " + "x" * 60), ("p", 1, 2, "！！")], "project_id string, page_index int, seg_seq int, text string")
    got = captions.chunk_captions(rows)
    assert [tuple(r)[2:] for r in got.orderBy("seg_seq", "cue_seq").collect()] == [(1, 1, "One two " + "x" * 20), (1, 2, "x" * 20), (1, 3, "x" * 20), (2, 1, "！！")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_fingerprints_work_out_no_moves(spark):
    class Still(shot_queries.Deck):
        focus = property(lambda self: (_ for _ in ()).throw(AssertionError("moves were asked for")))

    assert shot_queries.fingerprints(Still(spark, "/root/testdata/sf0.001")).count() > 0


def test_findings_share_the_pages_of_one_deck(spark, monkeypatch):
    """The rule on pauses read the documents again, several times, beside the pages that the others share."""
    def never(*_):
        raise AssertionError("pages were read again")

    monkeypatch.setattr(review_queries, "texts", never)
    monkeypatch.setattr(review_queries, "segments", never)
    monkeypatch.setattr(review_queries, "typed_pages", never)
    assert "monotone" in {r["kind"] for r in review_queries.findings(spark, "/root/testdata/sf0.001").select("kind").distinct().collect()}


def test_references_are_resolved_by_one_grouping(spark):
    """Joins by id and by label, each sorted on both sides in one task, took memory that grew with the table."""
    e = spark.createDataFrame([("p", 1, 1, "a", "L"), ("p", 1, 2, "b", "L"), ("p", 1, 3, "c", "b"), ("p", 2, 1, "a", None), ("p", 3, 1, "z", "z")], "project_id string, page_index int, seq int, element_id string, label string")
    refs = spark.createDataFrame([("p", 1, "L"), ("p", 1, "L"), ("p", 1, "b"), ("p", 1, "none"), ("p", 2, "a"), ("p", 2, None), ("q", 1, "a")], "project_id string, page_index int, ref string")
    got = document.resolve_elements(refs, e)
    assert sorted(tuple(r) for r in got.collect()) == [("p", 1, "L", "a"), ("p", 1, "b", "b"), ("p", 2, "a", "a")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_placeholder_scripts_deal_texts_by_page_alone(spark):
    pages = spark.createDataFrame([("p", n, "content", f"T{n}", [f"point {n}"], None, "s") for n in range(1, 8)], "project_id string, page_index int, page_type string, title string, key_points array<string>, speaker_notes string, summary string")
    e = spark.createDataFrame([("p", n, 1, f"e{n}", 0.5, f"point {n}") for n in range(1, 8)], "project_id string, page_index int, seq int, element_id string, importance double, text string")
    guide = spark.createDataFrame([("p", n, 200) for n in range(1, 8)] + [("p", 0, 200)], "project_id string, page_index int, chars int")
    got = drafts.placeholder_script(pages, e, guide)
    rows = {(r["page_index"], r["segment_no"]): (r["text"], r["target"]) for r in got.collect()}
    opens = [drafts.TRANSITIONS[(n - 1) % len(drafts.TRANSITIONS)].replace("%s", f"T{n}") for n in range(1, 8)]
    assert [rows[n, 1] for n in range(1, 8)] == [(t, None) for t in opens] and [rows[n, 2] for n in range(1, 8)] == [(f"point {n}。", f"e{n}") for n in range(1, 8)]
    window = re.search(r"Window \[.*", got._jdf.queryExecution().optimizedPlan().toString())
    assert "title" not in got._jdf.queryExecution().optimizedPlan().toString()[window.end() :].split("Join")[0]


def test_budgets_share_the_exact_sum_of_weights(spark):
    """Weights whose sum, added in page order, is off by its last bit."""
    rng = random.Random(4)
    kinds = [k for k in narration.TYPE_WEIGHTS if k != "other"]
    for _ in range(400):
        rows = [("p", i, rng.choice(kinds), "x" * rng.randrange(600)) for i in range(1, 8)]
        w = [narration.TYPE_WEIGHTS[k] * (1 + len(t) / 600) for _, _, k, t in rows]
        in_order = 0.0
        for x in w:
            in_order += x
        if in_order != math.fsum(w):
            break
    assert in_order != math.fsum(w)
    pages = spark.createDataFrame(rows, "project_id string, page_index int, page_type string, raw_text string")
    intents = spark.createDataFrame([("p", 100, [99])], "project_id string, duration int, emphasis_pages array<int>")
    got = {r.page_index: r.budget for r in narration.allocate_budget(pages, intents, 0.0).collect()}
    assert got == {i: max(4.0, min(75.0, 100.0 * x / math.fsum(w))) for (_, i, _, _), x in zip(rows, w, strict=True)}
