"""Joins of boxes by cells and buckets, against plain loops over all pairs."""

import random
import time

from deckloom.functions.cells import meet_boxes
from deckloom.operators import review, shots

W, H = 1920.0, 1080.0
ELEMENT = "project_id string, page_index int, seq int, element_id string, kind string, text string, title string, x double, y double, w double, h double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_meet_once(spark):
    rng = random.Random(3)
    box = lambda: (rng.uniform(-900, 2500), rng.uniform(-900, 1800), rng.choice([0.0, 5.0, 300.0, 4000.0]), rng.choice([0.0, 5.0, 200.0, 3000.0]))
    left, right = [(k % 2, k, *box()) for k in range(150)], [(k % 3, k, *box()) for k in range(150)]
    a = spark.createDataFrame([*left, (0, -1, None, 0.0, 1.0, 1.0)], "k int, i int, x double, y double, w double, h double")
    b = spark.createDataFrame([*right, (0, -2, 0.0, 0.0, None, 1.0)], "k int, j int, p double, q double, r double, s double")
    got = meet_boxes(a, b, ["k"], ["x", "y", "w", "h"], ["p", "q", "r", "s"], W, H)
    got = got.filter("x <= p + r AND p <= x + w AND y <= q + s AND q <= y + h")
    meets = lambda l, r: l[2] <= r[2] + r[4] and r[2] <= l[2] + l[4] and l[3] <= r[3] + r[5] and r[3] <= l[3] + l[5]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((l[1], r[1]) for l in left for r in right if l[0] == r[0] and meets(l, r))


def focus_of(e, page):
    """The rule as it reads, over all elements of the page."""
    able = [o for o in page if o[7] is not None and o[9] is not None and o[9] > 0 and o[4] != "title"]
    x, y, w, h = e[7:]
    if None in (x, y, w, h) or w < 0:
        return x, y, w, h
    while True:
        best = None
        for o in able:
            ox, oy, ow, oh = o[7:]
            ux, uy = min(x, ox), min(y, oy)
            u = (ux, uy, max(x + w, ox + ow) - ux, max(y + h, oy + oh) - uy)
            spans = ox <= x + 38.4 and ox + ow >= x + w - 38.4
            near = 0 <= y - (oy + oh) <= 32.4 or 0 <= oy - (y + h) <= 32.4 or (oy < y + h and oy + oh > y)
            if spans and near and u != (x, y, w, h) and u[2] * u[3] / (W * H) <= 0.3:
                best = min(best or (u[2] * u[3], o[2], u), (u[2] * u[3], o[2], u))
        if best is None:
            return x, y, w, h
        x, y, w, h = best[2]


def test_blocks_grow_as_they_do_over_whole_pages(spark):
    rng = random.Random(5)
    rows = []
    for page in range(12):
        for k in range(40):
            x, y = rng.choice([100.0, 120.0, 700.0, 1300.0]), rng.choice([40.0 * rng.randrange(25), rng.uniform(20, 1000)])
            kind = rng.choice(["text", "text", "image", "title"])
            rows.append(("p", page, k, f"e{k}", kind, f"words {k}", "head", x, y, rng.choice([0.0, 90.0, 300.0, 500.0, 1200.0]), rng.choice([10.0, 30.0, 200.0])))
    rows += [("p", 0, 90, "null", "text", "t", "head", None, 1.0, 5.0, 5.0), ("p", 0, 91, "flipped", "text", "t", "head", 400.0, 1.0, -50.0, 5.0), ("q", 1, 0, "alone", "text", "t", None, 1.0, 1.0, 5.0, 5.0)]
    rows.append(("p", 3, *rows[3 * 40 + 7][2:]))  # a row that is there twice keeps both of its rows
    got = shots.focus_boxes(spark.createDataFrame(rows, ELEMENT)).collect()
    want = [(e[0], e[1], e[3], *focus_of(e, [o for o in rows if o[:2] == e[:2]])) for e in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(tuple(r[3:]) != tuple(e[7:]) for r, e in zip(sorted(got, key=str), sorted(rows, key=str))) > 100


def test_a_page_of_2000_boxes(spark):
    grid = [("p", 1, k, f"e{k}", "text", f"w {k}", "head", 60.0 + 45 * (k % 40), 20.0 + 21 * (k // 40), 40.0, 10.0) for k in range(2000)]
    begun = time.monotonic()
    df = shots.focus_boxes(spark.createDataFrame(grid, ELEMENT))
    assert "CartesianProduct" not in plan_of(df) and "NestedLoopJoin" not in plan_of(df) and "__bucket" in plan_of(df)
    boxes = {tuple(r)[4:] for r in df.collect()}
    assert time.monotonic() - begun < 60
    assert all(h == 21 * 49 + 10.0 for *_, h in boxes)
    stacked = [("p", 1, k, f"e{k}", "text", f"w {k}", "head", 60.0, 20.0 + k % 2, 40.0, 10.0) for k in range(2000)]
    assert {tuple(r)[3:] for r in shots.focus_boxes(spark.createDataFrame(stacked, ELEMENT)).collect()} == {(60.0, 20.0, 40.0, 11.0)}


def test_captions_cover_what_they_cover_over_whole_pages(spark):
    rng = random.Random(8)
    cues = [("p", f"s{s}", k, 0.0, 8.0, "字" * rng.choice([3, 20, 45]), s) for s in range(4) for k in range(6)]
    zooms = [("p", c[1], c[2], (rng.uniform(0, 0.5), rng.uniform(0, 0.5), rng.uniform(0.1, 0.5), rng.uniform(0.1, 0.5))) for c in cues if rng.random() < 0.6]
    boxes = [("p", page, f"e{page}-{k}", f"e{page}-{k}", "words", rng.uniform(-50, 1900), rng.choice([rng.uniform(-50, 1070), rng.uniform(700, 1070)]), rng.choice([20.0, 300.0, 1500.0]), rng.choice([20.0, 60.0, 500.0]), *rng.choice([(W, H), (960.0, 720.0)]), 0.8) for page in range(4) for k in range(500)]
    c = spark.createDataFrame(cues, "project_id string, scene_id string, cue_seq int, start double, end double, text string, page_index int")
    z = spark.createDataFrame(zooms, "project_id string, scene_id string, cue_seq int, area struct<x:double,y:double,w:double,h:double>")
    e = spark.createDataFrame(boxes, "project_id string, page_index int, element_id string, label string, text string, x double, y double, w double, h double, page_w double, page_h double, importance double")
    df = review.check_caption_cover(c, e, z)
    assert "__column" in plan_of(df) and "NestedLoopJoin" not in plan_of(df)
    drawn = {(r.scene_id, r.cue_seq): r.b for r in c.select("scene_id", "cue_seq", review.subtitle_box(c.text).alias("b")).collect()}
    lens, want = {(r[1], r[2]): r[3] for r in zooms}, {}
    for _, scene, k, *_, page in cues:
        b, area = drawn[scene, k], lens.get((scene, k))
        for box in boxes:
            if box[1] != page:
                continue
            x, y, w, h, pw, ph = box[5:11]
            fit = min(W / pw, H / ph)
            x, y, w, h = x * fit + (W - pw * fit) / 2, y * fit + (H - ph * fit) / 2, w * fit, h * fit
            if area:
                push = min(1 / area[2], 1 / area[3])
                x, y, w, h = (x - area[0] * W) * push, (y - area[1] * H) * push, w * push, h * push
                if x + w <= 0 or x >= W or y + h <= 0 or y >= H:
                    continue
            side = lambda p, n, q, m: max(0.0, min(p + n, q + m) - max(p, q))
            if side(b.x, b.w, x, w) * side(b.y, b.h, y, h) / (w * h) >= 0.25:
                want.setdefault((scene, box[2]), set()).add(bool(area))
    got = [(r.scene_id, r.message) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == set(want)
    assert sum(w == {True} for w in want.values()) >= 5 and sum(w == {False} for w in want.values()) >= 5
