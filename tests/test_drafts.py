"""Rules on Chinese rows that the tables at hand don't have, and pause matching against all choices."""

import itertools
import random

from pyspark.sql import functions as F

from deckloom.operators import captions, drafts, intent


def test_numbers_and_lengths(spark):
    texts = ["七分钟", "十五秒", "二十五分钟", "一个小时半", "半小时", "五分半", "5 分 30 秒", "十分重要", "半分钟"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(intent.stated_duration(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [420.0, 15.0, 1500.0, 5400.0, 1800.0, 330.0, 330.0, None, 30.0]


def test_tics_and_beats(spark):
    rows = [("p", "a", "这不是工具，而是平台。"), ("p", "b", "是数据，数据会说话。"), ("p", "c", "普通的一句。"), ("p", "d", None)]
    df = spark.createDataFrame(rows, "project_id string, scene_id string, narration string")
    got = {(r.scene_id, r.message) for r in drafts.check_tics(df).collect()}
    assert got == {("a", "否定断言：不是工具，而是"), ("b", "顶针重锤：是数据，数据")}
    df = spark.createDataFrame([("但是不行", False), ("接下来看", False), ("然后", False), ("然后", True)], "t string, e boolean")
    assert [r.b for r in df.select(captions.beat_before(F.col("t"), F.col("e")).alias("b")).collect()] == [0.95, 0.95, 0.0, 1.2]


def test_pauses_match_as_all_choices_do(spark):
    rng = random.Random(7)
    expected, pauses, want = [], [], {}
    for page in range(1, 9):
        n, m = rng.randint(1, 3), rng.randint(1, 6)
        e = sorted(round(rng.uniform(0, 10), 2) for _ in range(n))
        p = sorted((round(rng.uniform(0, 10), 2), round(rng.uniform(0.1, 0.9), 2)) for _ in range(m))
        expected += [("p", page, i + 1, x) for i, x in enumerate(e)]
        pauses += [("p", page, mid + d / 2, d) for mid, d in p]
        if m >= n:
            cost = lambda c: sum(abs(p[j][0] - x) - p[j][1] for j, x in zip(c, e))  # noqa: B023, E731
            want[page] = min(map(cost, itertools.combinations(range(m), n)))
    # Too few pauses, no pauses, and pauses alone: no rows.
    expected += [("p", 9, 1, 2.0), ("p", 9, 2, 4.0), ("p", 10, 1, 3.0)]
    pauses += [("p", 9, 2.5, 0.5), ("p", 11, 1.5, 0.5)]
    a = spark.createDataFrame(expected, "project_id string, page_index int, seg_seq int, expected double")
    b = spark.createDataFrame(pauses, "project_id string, page_index int, end double, duration double")
    got = captions.match_boundaries(a, b).join(a, ["project_id", "page_index", "seg_seq"]).collect()
    length = {(page, round(end - d / 2, 6)): d for _, page, end, d in pauses}
    cost = {}
    for r in got:
        cost[r.page_index] = cost.get(r.page_index, 0) + abs(r.at - r.expected) - length[(r.page_index, round(r.at, 6))]
    assert cost.keys() == want.keys() and all(abs(cost[k] - want[k]) < 1e-6 for k in want)


def test_prompts_quote_the_nearest_written_pages(spark):
    pages = spark.createDataFrame([("p", i, "content", "" if i == 2 else f"T{i}", 100) for i in range(1, 10)], "project_id string, page_index int, page_type string, title string, chars int")
    parts = spark.createDataFrame([("p", 5, 2, "e2", "bullet", "x" * 130), ("p", 5, 1, "e1", "title", "a  \n b"), ("p", 6, 1, "e1", "title", "")], "project_id string, page_index int, seq int, element_id string, kind string, text string")
    decks = spark.createDataFrame([("p", "", None, "S", "all", "formal", "calm", "")], "project_id string, title string, topic string, summary string, audience string, style string, tone string, instructions string")
    kept = spark.createDataFrame([("p", 4, "k" * 250), ("p", 7, "seven"), ("p", 9, "w" * 250)], "project_id string, page_index int, narration string")
    got = {r.batch: r.prompt for r in drafts.narration_prompts(pages, parts, decks, kept).collect()}
    assert sorted(got) == [0, 1]  # the third batch is page 9, which is written
    lines = got[1].split("\n")
    assert lines[:3] == ["# 文档：未命名", "主题：未知", "整体摘要：S"] and "风格：" + drafts.STYLE_BRIEFS["formal"] in lines
    assert lines[lines.index("# 上文（第 4 页，已写好，结尾）") + 1] == "…" + "k" * 200
    assert lines[lines.index("# 下文（第 9 页，已写好，开头）") + 1] == "w" * 199 + "…"
    assert "# 页面（全文第 5 页起，共 9 页）" in lines and "## 第 5 页｜content｜T5｜待补写" in lines and "已写好的讲稿：seven" in lines
    at = lines.index("元素：")
    assert lines[at + 1 : at + 3] == ["  - e1｜title｜a b", "  - e2｜bullet｜" + "x" * 119 + "…"] and lines.count("元素：") == 1
    assert "## 第 2 页｜content｜无标题｜待补写" in got[0] and "上文" not in got[0]
    alone = {r.batch: r.prompt for r in drafts.narration_prompts(pages, parts, decks).collect()}
    assert sorted(alone) == [0, 1, 2] and "待补写" not in alone[0] and drafts.FILL_IN not in alone[0]


def test_prompts_name_their_deck(spark):
    pages = spark.createDataFrame([("p", 1, "A", "say  this"), ("p", 2, None, None), ("q", 1, "B", "")], "project_id string, page_index int, title string, speaker_notes string")
    parts = spark.createDataFrame([("p", 1, 1, "e1", "title", "A")], "project_id string, page_index int, seq int, element_id string, kind string, text string")
    decks = spark.createDataFrame([("p", "Plan"), ("q", "")], "project_id string, title string")
    got = {r.project_id: r.prompt.split("\n") for r in drafts.prompt_batches(pages, parts, decks=decks).collect()}
    assert got["p"][:3] == ["# 文档：Plan（共 2 页）", "", "# 本批页面"] and "  - e1｜title｜A" in got["p"]
    assert got["q"][0] == "# 文档：未命名（共 1 页）" and "（这一页没有可提取的文字，请看配图）" in got["q"]
    assert drafts.prompt_batches(pages, parts).filter("project_id = 'p'").first().prompt.startswith("# 文档：未命名（共 2 页）")
