"""Pages that hold what is on them: the same rows as by joins, and texts that move once."""

import random
from itertools import accumulate

from deckloom.functions import arrays
from deckloom.operators import attention, captions, narration
from deckloom.plans import caption_queries, review_queries, shot_queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PAGE = ["project_id", "page_index"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_running_sums_and_halving(spark):
    rng = random.Random(2)
    rows = [(n, [rng.randrange(-5, 9) for _ in range(n)], rng.randrange(-3, 12)) for n in (0, 1, 2, 255, 256, 257, 1000)]
    df = spark.createDataFrame(rows, "n int, v array<bigint>, x int")
    up = F.array_sort("v")
    first = arrays.first_above(up, arrays.halvings(F.size("v")), F.col("x"))
    for r, (_, v, x) in zip(df.select("n", arrays.running(F.col("v")).alias("s"), first.alias("f")).orderBy("n").collect(), rows, strict=True):
        assert r.s == list(accumulate(v)) and r.f == min((y for y in v if y > x), default=None)


def test_captions_of_a_page_are_cut_as_by_joins(spark):
    rng = random.Random(3)
    words = ["one", "two,", "three.", "four;", "a" * 40, "five", "。", "six"]
    said = [("p", i, " ".join(rng.choices(words, k=rng.randrange(0, 90)))) for i in range(1, 30)]
    texts = spark.createDataFrame(said, "project_id string, page_index int, narration string")
    pauses = [("p", rng.randrange(1, 31), round(rng.uniform(0, 40), 3), rng.choice([0.3, 0.5, 0.9])) for _ in range(400)]
    pauses = spark.createDataFrame(pauses, "project_id string, page_index int, end double, duration double")
    totals = texts.select(*PAGE, (F.length("narration") / 8.0).alias("total"))
    s = narration.split_segments(texts, narration.SENTENCES_LATIN)
    want = captions.split_at_pauses(captions.caption_times(captions.chunk_captions(s), narration.allocate_segments(s, totals)), pauses)
    held = pauses.groupBy(*PAGE).agg(F.collect_list(F.struct("end", "duration")).alias("pauses"))
    pages = texts.select(*PAGE, narration.timed_sentences(F.col("narration"), F.length("narration") / 8.0, narration.SENTENCES_LATIN).alias("sentences")).join(held, PAGE, "left")
    got = captions.split_on_pages(pages.withColumn("pauses", F.coalesce("pauses", F.array().cast("array<struct<end:double,duration:double>>"))))
    rows = lambda df: sorted(tuple(r) for r in df.select(want.columns).collect())
    assert rows(got) == rows(want) and {r[4] for r in rows(got)} == {1, 2}


def test_captions_are_split_where_their_page_is(spark):
    """Texts, sentences and times were stored, then captions and pauses sorted and joined four times."""
    plan = plan_of(caption_queries.split(spark, SF))
    assert "Join" not in plan and "Window" not in plan and plan.count("split(") == 3  # into lines, sentences and clauses


def test_targets_are_found_on_pages_as_by_joins(spark, monkeypatch):
    """Also on pages with more elements than are looked for one by one."""
    monkeypatch.setattr(attention, "FEW", 5)
    rng = random.Random(5)
    said, told = [], []
    for page in range(1, 25):
        for seq in range(1, rng.choice([3, 6, 12]) + 1):
            text = rng.choice(["", "Alpha beta", "alpha", "Gamma", "Agenda", "12", "delta x", "de", "Title"])
            told.append(("p", page, seq, f"e{seq}", rng.choice([None, "e1", text[:3]]), rng.choice(["title", "image", "paragraph", "bullet"]), rng.choice([0.5, 0.6, 0.9]), text, 9.0, 8.0, "Title"))
        for seq in range(1, 10):
            said.append(("p", page, seq, " ".join(rng.choices(["Alpha beta", "alpha", "Gamma", "delta x", "none", "Title"], k=2)), seq * 1.0, seq + 1.0))
    e = spark.createDataFrame(told, "project_id string, page_index int, seq int, element_id string, label string, kind string, importance double, text string, w double, h double, title string")
    s = spark.createDataFrame(said, "project_id string, page_index int, seg_seq int, text string, start double, end double")
    refs = F.when(F.col("seg_seq") % 2 == 0, F.array(F.lit("none"), F.format_string("e%d", "seg_seq"), F.lit("Alp"))).otherwise(F.array().cast("array<string>"))
    want = attention.resolve_targets(s.withColumn("element_refs", refs), e)
    held = lambda df: F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c not in (*PAGE, "title")])))
    pages = e.groupBy(*PAGE, "title").agg(held(e).alias("elements")).join(s.groupBy(*PAGE).agg(held(s).alias("sentences")), PAGE)
    got = attention.targets_on_pages(pages, refs).select(*PAGE, "seg_seq", "target.element_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and got.count() > 60


def test_texts_of_a_deck_move_once(spark):
    """Elements, pages, sentences and captions were each stored and joined again for the queries on moves."""
    deck = shot_queries.Deck(spark, SF)
    for df in (deck.elements, deck.pages, deck.segments, deck.told, shot_queries.fingerprints(deck)):
        plan = plan_of(df)
        assert "Join" not in plan and "Aggregate" not in plan.replace("aggregate", "") and "Window" not in plan and "/deck-" in df.inputFiles()[0]


def test_pages_read_aloud_are_compared_in_their_row(spark):
    """Texts were joined to their neighbours', then the pairs of characters of both to each other."""
    rows = [("p", 1, "abcdef"), ("p", 2, "xyz"), ("p", 3, "xyzx"), ("p", 5, "gap"), ("q", 3, "")]
    found = review_queries.read_aloud(spark.createDataFrame(rows, "project_id string, page_index int, raw_text string"))
    assert sorted((r.project_id, r.scene_id, r.message) for r in found.collect()) == [("p", "scene_02", "100%"), ("p", "scene_03", "100%")]
    assert "Join" not in plan_of(found)
