"""Page and element analytics of decks. Tables are keyed by project and page; a page's elements are few."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from deckloom.functions.text import looks_like_bullet, looks_numeric, stripped, truncate_clause

PAGE = ["project_id", "page_index"]
# Words that tell a page's kind, looked for in its title and first text.
AGENDA_WORDS = ("目录", "议程", "contents", "agenda", "outline")
SUMMARY_WORDS = ("总结", "小结", "结论", "summary", "conclusion", "thank")
CONTACT_WORDS = ("联系", "contact", "微信", "电话", "email", "邮箱")
ARCHITECTURE_WORDS = ("架构", "architecture", "技术方案", "系统", "流程")
TEXT_LIGHT = 80


def _ordered(value: Column, order: str = "seq") -> Column:
    """The non-null values of a group as an array in the order of a column."""
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda x: x["v"])


def scale_boxes(blocks: DataFrame, zoom: float, min_side: float) -> DataFrame:
    """DOC-2: boxes ``x0..y1`` in page points as ``x, y, w, h`` in pixels, without those under ``min_side``."""
    box = {"x": F.col("x0") * zoom, "y": F.col("y0") * zoom, "w": F.col("x1") * zoom - F.col("x0") * zoom, "h": F.col("y1") * zoom - F.col("y0") * zoom}
    return blocks.withColumns(box).drop("x0", "y0", "x1", "y1").filter((F.col("w") >= min_side) & (F.col("h") >= min_side))


def classify_elements(elements: DataFrame) -> DataFrame:
    """DOC-3: ``kind`` and ``importance`` by type size within the page; images (``is_image``) keep theirs."""
    page = Window.partitionBy(*PAGE)
    sizes = F.array_sort(F.collect_list(F.when(~F.col("is_image") & (F.col("font_size") > 0), F.col("font_size"))).over(page))
    rows = elements.withColumn("__sizes", sizes)
    median = F.get("__sizes", F.floor(F.size("__sizes") / 2).cast("int"))
    size, sized = F.col("font_size"), F.size("__sizes") > 0
    rules = [
        (F.col("is_image"), "image", 0.5),
        (sized & (size >= F.array_max("__sizes") - 0.5), "title", 0.9),
        (sized & (size > median * 1.15), "subtitle", 0.7),
        (sized & looks_like_bullet(F.col("text")), "bullet", 0.6),
        (sized & looks_numeric(F.col("text")), "number", 0.8),
    ]
    kind, importance = F.lit("paragraph"), F.lit(0.5)
    for test, name, weight in reversed(rules):
        kind, importance = F.when(test, name).otherwise(kind), F.when(test, weight).otherwise(importance)
    return rows.withColumns({"kind": kind, "importance": importance}).drop("__sizes")


def classify_shapes(shapes: DataFrame) -> DataFrame:
    """DOC-5: placeholder 0 is the title; several paragraphs or an indent make bullets; else a paragraph."""
    title, bullets = F.col("placeholder") == 0, (F.col("paragraphs") > 1) | (F.col("level") > 0)
    kind = F.when(title, "title").when(bullets, "bullet").otherwise("paragraph")
    return shapes.withColumns({"kind": kind, "importance": F.when(title, 0.9).when(bullets, 0.6).otherwise(0.5)})


def promote_titles(elements: DataFrame) -> DataFrame:
    """DOC-6: a page without a title gets one: its largest paragraph or bullet, the topmost among equals."""
    page = Window.partitionBy(*PAGE)
    able = F.col("kind").isin("paragraph", "bullet") & (F.coalesce("text", F.lit("")) != "")
    rank = F.row_number().over(page.orderBy(F.desc(able.cast("int")), F.desc("font_size"), "y", "seq"))
    none = F.max((F.col("kind") == "title").cast("int")).over(page) == 0
    rows = elements.withColumn("__up", none & able & (rank == 1))
    up = F.col("__up")
    return rows.withColumns({"kind": F.when(up, "title").otherwise(F.col("kind")), "importance": F.when(up, 0.9).otherwise(F.col("importance"))}).drop("__up")


def page_titles(elements: DataFrame, fall_back: bool = True) -> DataFrame:
    """DOC-7: the first title element's text, else the first text cut to 60 characters."""
    return elements.groupBy(*PAGE).agg(_title(fall_back))


def _title(fall_back: bool = True) -> Column:
    text = F.nullif(F.col("text"), F.lit(""))
    title = F.min_by(text, F.when((F.col("kind") == "title") & text.isNotNull(), F.col("seq")))
    first = F.min_by(F.substring(text, 1, 60), F.when(text.isNotNull(), F.col("seq")))
    return F.coalesce(title, first if fall_back else F.lit(None), F.lit("")).alias("title")


def page_text(elements: DataFrame) -> DataFrame:
    """DOC-8: non-empty element texts joined by newlines."""
    return elements.groupBy(*PAGE).agg(_raw_text())


def _raw_text() -> Column:
    return stripped(F.array_join(_ordered(F.nullif(F.col("text"), F.lit(""))), "\n")).alias("raw_text")


def joined_text(elements: str) -> Column:
    """DOC-8 of an array of a page's elements in order."""
    return stripped(F.array_join(F.filter(F.transform(elements, lambda e: F.nullif(e["text"], F.lit(""))), lambda t: t.isNotNull()), "\n"))


def table_text(cells: DataFrame, rows: int = 12) -> DataFrame:
    """DOC-9: cells joined by bars, rows by newlines, the first twelve rows."""
    kept = cells.filter(F.col("row") < rows).groupBy(*PAGE, "element_id", "row").agg(F.array_join(_ordered(F.col("text"), "col"), " | ").alias("line"))
    return kept.groupBy(*PAGE, "element_id").agg(F.array_join(_ordered(F.col("line"), "row"), "\n").alias("text"))


def resolve_elements(refs: DataFrame, elements: DataFrame) -> DataFrame:
    """DOC-11: each reference's element on its page, by id or label; the first in order wins.

    ``refs`` are ``project_id, page_index, ref``. They and the names of elements, ids and labels alike, are put together and grouped
    by page and name once; joins by id and by label sorted both sides twice in one task.
    """
    names = elements.select(*PAGE, F.explode(F.array_distinct(F.array("element_id", "label"))).alias("ref"), "seq", "element_id", F.lit(False).alias("__asked"))
    asked = refs.select(*PAGE, "ref", F.lit(None).cast(elements.schema["seq"].dataType).alias("seq"), F.lit(None).cast("string").alias("element_id"), F.lit(True).alias("__asked"))
    rows = names.unionByName(asked).filter("ref IS NOT NULL").groupBy(*PAGE, "ref")
    found = rows.agg(F.min_by("element_id", "seq").alias("element_id"), F.bool_or("__asked").alias("__asked"), F.bool_and("__asked").alias("__unknown"))
    return found.filter("__asked AND NOT __unknown").drop("__asked", "__unknown")


def classify_pages(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """DOC-12: ``page_type`` of pages ``project_id, page_index, title, raw_text``, by the first rule that holds."""
    return _typed(pages.join(elements.groupBy(*PAGE).agg(*_seen()), PAGE, "left"))


def typed_pages(elements: DataFrame) -> DataFrame:
    """DOC-7, DOC-8 and DOC-12 of classified elements in one grouping, so that their texts move once: ``project_id, page_index,
    title, raw_text, page_type``."""
    return _typed(elements.groupBy(*PAGE).agg(_title(), _raw_text(), *_seen()))


def whole_pages(elements: DataFrame) -> DataFrame:
    """DOC-3, DOC-7, DOC-8 and DOC-12 of raw elements: a row for each page, ``project_id, page_index, title, raw_text, page_type``,
    with its classified ``elements`` in order. Elements are dealt by project, as the last page of a deck is asked for, so texts move once."""
    e = classify_elements(elements.repartition("project_id"))
    parts = F.array_sort(F.collect_list(F.struct("seq", *[c for c in e.columns if c not in ("seq", *PAGE)])))
    return _typed(e.groupBy(*PAGE).agg(_title(), _raw_text(), *_seen(), parts.alias("elements")))


def _seen() -> list[Column]:
    has = lambda k: F.max((F.col("kind") == k).cast("int"))
    return [has("chart").alias("__chart"), has("image").alias("__image"), F.count("*").alias("__n")]


def _typed(pages: DataFrame) -> DataFrame:
    head = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("raw_text", F.lit("")), 1, 200)))
    said = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(head, w))
    last = F.max("page_index").over(Window.partitionBy("project_id"))
    kind = (
        F.when(F.col("page_index") == 1, "cover")
        .when(said(AGENDA_WORDS), "agenda")
        .when(said(CONTACT_WORDS), "contact")
        .when(said(SUMMARY_WORDS) | (F.col("page_index") == last), "summary")
        .when(said(ARCHITECTURE_WORDS), "architecture")
        .when(F.col("__chart") == 1, "chart")
        .when((F.col("__image") == 1) & (F.col("__n") <= 3), "section")
        .otherwise("content")
    )
    return pages.withColumn("page_type", kind).drop("__chart", "__image", "__n")


def key_points(elements: DataFrame, limit: int = 60, most: int = 4) -> DataFrame:
    """DOC-13: the first four lines of bullets, numbers and charts, cut by clause; if none, of paragraphs and subtitles."""
    bullets = elements.filter(F.col("kind").isin("bullet", "number", "chart")).select(*PAGE, "seq", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    bullets = bullets.withColumn("line", F.regexp_replace("line", r"^[ •\-·*\t]+|[ •\-·*\t]+$", "")).filter(F.length("line") >= 2).withColumn("rank", F.lit(0))
    body = elements.filter(F.col("kind").isin("paragraph", "subtitle")).select(*PAGE, "seq", F.lit(0).alias("i"), stripped(F.col("text")).alias("line"), F.lit(1).alias("rank"))
    rows = bullets.unionByName(body.filter("line <> ''")).withColumn("line", truncate_clause(F.col("line"), limit))
    best = F.min("rank").over(Window.partitionBy(*PAGE))
    rows = rows.withColumn("__best", best).filter("rank = __best")
    pairs = F.array_sort(F.collect_list(F.struct("seq", "i", "line")))
    return rows.groupBy(*PAGE).agg(F.slice(F.transform(pairs, lambda x: x["line"]), 1, most).alias("key_points"))


def build_sections(pages: DataFrame) -> DataFrame:
    """DOC-15: ``project_id, section_no, title, page_indexes``; cover, agenda and section pages begin one, as does the first."""
    order = Window.partitionBy("project_id").orderBy("page_index")
    begins = F.col("page_type").isin("cover", "agenda", "section") | (F.row_number().over(order) == 1)
    rows = pages.withColumn("__b", begins.cast("int"))
    rows = rows.withColumn("section_no", F.sum("__b").over(order).cast("int"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.format_string("第 %d 部分", "page_index"))
    return rows.groupBy("project_id", "section_no").agg(
        F.min_by(title, "page_index").alias("title"), F.array_sort(F.collect_list("page_index")).alias("page_indexes")
    )


def deck_rollup(pages: DataFrame) -> DataFrame:
    """DOC-16: topic (first title), summary (titles of the first three pages) and concepts (first eight titles)."""
    title = F.nullif(F.col("title"), F.lit(""))
    titles = _ordered(title, "page_index")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("page_index"))
    early = _ordered(F.when(F.col("__place") <= 3, title), "page_index")
    return pages.withColumn("__place", place).groupBy("project_id").agg(
        F.coalesce(F.get(titles, F.lit(0)), F.lit("")).alias("topic"),
        F.array_join(early, "、").alias("summary"),
        F.slice(titles, 1, 8).alias("concepts"),
    )


def presentation_order(pages: DataFrame) -> DataFrame:
    """DOC-17: all pages but contact pages, as an array."""
    kept = F.when(F.col("page_type") != "contact", F.col("page_index"))
    return pages.groupBy("project_id").agg(F.array_sort(F.collect_list(kept)).alias("page_order"))


def merge_order(answer: DataFrame, pages: DataFrame, seen: DataFrame) -> DataFrame:
    """DOC-18: ``project_id, place, page_index``: the answer's known pages in its order, then pages that the answer
    could not see, in page order, without contact pages. ``answer`` has ``place, page_index``."""
    known = answer.join(pages.select(*PAGE), PAGE, "left_semi").select("project_id", F.lit(0).alias("late"), F.col("place").alias("o"), "page_index")
    rest = pages.filter("page_type <> 'contact'").join(answer, PAGE, "left_anti").join(seen.select(*PAGE), PAGE, "left_anti")
    rest = rest.select("project_id", F.lit(1).alias("late"), F.col("page_index").alias("o"), "page_index")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("late", "o"))
    return known.unionByName(rest).withColumn("place", place).select("project_id", "place", "page_index")


def ordered_pages(orders: DataFrame, pages: DataFrame) -> DataFrame:
    """DOC-19: ``project_id, place, page_index``; an explicit order rules and drops unknown ids, an empty one is page order."""
    given = orders.filter(F.size("page_order") > 0).select("project_id", F.posexplode("page_order").alias("o", "page_index"))
    given = given.join(pages.select(*PAGE), PAGE)
    free = pages.join(orders.filter(F.size("page_order") > 0).select("project_id"), "project_id", "left_anti")
    rows = given.select("project_id", "o", "page_index").unionByName(free.select("project_id", F.col("page_index").alias("o"), "page_index"))
    return rows.select("project_id", F.row_number().over(Window.partitionBy("project_id").orderBy("o")).alias("place"), "page_index")


def merge_understanding(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """DOC-20: a non-empty incoming title or summary wins; the page type is always taken."""
    new = answers.select(*PAGE, *[F.col(c).alias(f"__{c}") for c in ("page_type", "title", "summary")], F.lit(True).alias("__read"))
    rows = pages.join(new, PAGE, "left")
    won = {c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)) for c in ("title", "summary")}
    won["page_type"] = F.when(F.col("__read"), F.col("__page_type")).otherwise(F.col("page_type"))
    return rows.withColumns(won).drop("__page_type", "__title", "__summary", "__read")


def merge_importance(elements: DataFrame, scores: DataFrame) -> DataFrame:
    """DOC-20: scores of known elements, clamped to 0..1; scores of unknown ones are ignored."""
    new = scores.select(*PAGE, "element_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("importance"))).alias("__new"))
    return elements.join(new, [*PAGE, "element_id"], "left").withColumn("importance", F.coalesce("__new", "importance")).drop("__new")


def visual_batches(pages: DataFrame, elements: DataFrame, batch: int = 6, k: int = 4) -> DataFrame:
    """DOC-21: ``project_id, page_index, batch, weight, rank`` of the k pages of each batch that say most by pictures."""
    points = F.when(F.col("kind") == "chart", 2.0).when(F.col("kind") == "image", 1.5).when(F.col("kind") == "table", 0.5).otherwise(0.0)
    drawn = elements.groupBy(*PAGE).agg(F.sum(points).alias("__drawn"))
    weight = F.coalesce("__drawn", F.lit(0.0)) + F.when(F.length("raw_text") < TEXT_LIGHT, 1.0).otherwise(0.0)
    weight = weight + F.when(F.col("page_type") == "architecture", 1.5).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("page_index"))
    rows = pages.join(drawn, PAGE, "left").withColumn("batch", F.floor((place - 1) / batch).cast("int")).withColumn("weight", weight)
    rank = F.row_number().over(Window.partitionBy("project_id", "batch").orderBy(F.desc("weight"), "page_index"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select(*PAGE, "batch", "weight", "rank")


def rescale_pages(elements: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    """DOC-22: boxes in a page's new size; nothing changes if the page had no size or both ratios are 1."""
    new = dims.select(*PAGE, F.col("width").alias("__w"), F.col("height").alias("__h"))
    rows = elements.join(pages.select(*PAGE, "width", "height"), PAGE).join(new, PAGE)
    sx, sy = F.col("__w") / F.nullif(F.col("width"), F.lit(0.0)), F.col("__h") / F.nullif(F.col("height"), F.lit(0.0))
    keep = sx.isNull() | sy.isNull() | ((F.abs(sx - 1) < 1e-6) & (F.abs(sy - 1) < 1e-6))
    scaled = {c: F.when(keep, F.col(c)).otherwise(F.col(c) * r) for c, r in (("x", sx), ("y", sy), ("w", sx), ("h", sy))}
    return rows.withColumns(scaled).drop("width", "height", "__w", "__h")


def diagram_edges(shapes: DataFrame, elements: DataFrame, connectors: DataFrame) -> DataFrame:
    """DOC-23: ``project_id, page_index, edge_seq, source, target``: connectors between elements, through shape texts.

    Dangling connectors and loops go, and so do pages with fewer than two edges.
    """
    named = elements.withColumn("text", stripped(F.col("text"))).filter("text <> ''")
    named = named.groupBy(*PAGE, "text").agg(F.min_by("element_id", "seq").alias("element_id"))
    at = shapes.withColumn("text", stripped(F.col("text"))).join(named, [*PAGE, "text"]).select(*PAGE, "shape_id", "element_id")
    ends = connectors
    for side, shape in (("source", "start_shape"), ("target", "end_shape")):
        ends = ends.join(at.withColumnsRenamed({"shape_id": shape, "element_id": side}), [*PAGE, shape])
    edges = ends.filter("source <> target").withColumn("__n", F.count("*").over(Window.partitionBy(*PAGE)))
    return edges.filter("__n >= 2").select(*PAGE, "edge_seq", "source", "target")


@F.pandas_udf(ArrayType(StringType()))
def _walked(sources: pd.Series, targets: pd.Series) -> pd.Series:
    """The nodes of each page's arrows, given by both their ends in order, as they are walked."""

    def walk(source: Sequence[str], target: Sequence[str]) -> list[str]:
        waiting, after = {}, {}
        for s, t in zip(source, target, strict=True):
            waiting.setdefault(s, 0)
            waiting[t] = waiting.get(t, 0) + 1
            after.setdefault(s, []).append(t)
        done = [n for n, before in waiting.items() if not before]
        for node in done:  # grows as it is walked
            for t in after.get(node, ()):
                waiting[t] -= 1
                if not waiting[t]:
                    done.append(t)
        met = set(done)
        return done + [n for n in waiting if n not in met]

    return pd.Series([walk(s, t) for s, t in zip(sources, targets, strict=True)], dtype=object)


def flow_order(edges: DataFrame) -> DataFrame:
    """DOC-24: ``project_id, page_index, place, node`` in the order the arrows walk; nodes on cycles come last as declared.

    A page's graph is a handful of edges, so each page is walked in one row, and pages go to Python many at a time.
    """
    arrows = F.array_sort(F.collect_list(F.struct("edge_seq", "source", "target")))
    rows = edges.groupBy(*PAGE).agg(arrows.alias("__e")).select(*PAGE, _walked(F.col("__e.source"), F.col("__e.target")).alias("__n"))
    return rows.select(*PAGE, F.posexplode("__n").alias("i", "node")).select(*PAGE, (F.col("i") + 1).alias("place"), "node")


def flow_text(order: DataFrame, elements: DataFrame) -> DataFrame:
    """DOC-25: the flow's labels, joined by arrows."""
    said = F.coalesce(F.nullif("text", F.lit("")), F.nullif("label", F.lit("")), F.col("element_id"))
    named = elements.select(*PAGE, F.col("element_id").alias("node"), stripped(said).alias("said"))
    rows = order.join(named, [*PAGE, "node"], "left").withColumn("said", F.coalesce("said", "node")).filter("said <> ''")
    return rows.groupBy(*PAGE).agg(F.array_join(_ordered(F.col("said"), "place"), " → ").alias("flow"))


def element_census(elements: DataFrame) -> DataFrame:
    """DOC-26: ``kind, n, pages``, most frequent kind first."""
    by_page = elements.groupBy("kind", *PAGE).agg(F.count("*").alias("__n"))
    return by_page.groupBy("kind").agg(F.sum("__n").alias("n"), F.count("*").alias("pages")).orderBy(F.desc("n"), "kind")
