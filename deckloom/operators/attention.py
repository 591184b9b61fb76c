"""What each sentence should draw the eye to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions.text import stripped

# Words on a page that are decoration, whatever the page.
DECORATION = ("contents", "content", "agenda", "outline", "index", "目录", "大纲", "议程", "thank you", "thanks", "谢谢", "感谢", "汇报人", "报告人", "logo")
SIGNPOSTS = ("cover", "section")
#: Beginnings of elements on a page that are looked for one by one in each of its sentences; more are joined by runs of characters.
FEW = 64


def worth_pointing_at(get: Callable[[str], Column] = F.col) -> Column:
    """DIR-1: a chart, table or image; or two characters of text or more, with a letter, that aren't decoration, whatever
    spaces, full stops, commas, dots and colons stand around it."""
    text = stripped(F.coalesce(get("text"), F.lit("")))
    told = (F.length(text) >= 2) & ~F.btrim(F.lower(text), F.lit(" .、·:：")).isin(*DECORATION) & text.rlike(r"\p{L}")
    return get("kind").isin("chart", "table", "image") | told


def is_banner(title: str = "title", get: Callable[[str], Column] = F.col) -> Column:
    """DIR-2: the page's title, by kind or by its words; what has no words isn't one by them."""
    text = stripped(F.coalesce(get("text"), F.lit("")))
    return (get("kind") == "title") | ((text != "") & (text == stripped(F.coalesce(F.col(title), F.lit("")))))


def is_backdrop(width: float = 1920.0, height: float = 1080.0, slack: float = 0.01) -> Column:
    """DIR-3: without words, and touching two neighbouring edges of the page."""
    sides = [F.col("x") <= width * slack, F.col("y") <= height * slack, F.col("x") + F.col("w") >= width * (1 - slack), F.col("y") + F.col("h") >= height * (1 - slack)]
    near = (sides[0] | sides[2]) & (sides[1] | sides[3])
    return (stripped(F.coalesce("text", F.lit(""))) == "") & near


def coverage(width: float = 1920.0, height: float = 1080.0) -> Column:
    """DIR-4: the box's share of the page."""
    return F.col("w") * F.col("h") / (width * height) if width and height else F.lit(1.0)


def windows(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def resolve_targets(segments: DataFrame, elements: DataFrame) -> DataFrame:
    """DIR-5: ``project_id, page_index, seg_seq, element_id``: a sentence's target.

    The first of its references that can be pointed at and is no banner; a reference means the first element of the page with
    this id or label. Else the most important element that can be pointed at and isn't of the kind title, and whose first
    six characters (all, if fewer, but two at least) stand in the sentence; the first among equals.

    Both joins are on the page and a string. Beginnings go to the sentences of their page as one array, and a sentence is joined by
    the first that it holds. On a page with over ``FEW`` of them it is instead turned into its runs of as many characters as
    beginnings on its page have, so sentences and elements of a page that share none never meet; there is a row for each
    character of a text then, which would fill the disk if it were done for all pages.
    """
    page = ["project_id", "page_index"]
    known = elements.withColumns({"__able": worth_pointing_at(), "__banner": is_banner()})
    names = known.select(*page, "seq", "element_id", "__able", "__banner", F.explode(F.array_distinct(F.array("element_id", "label"))).alias("__ref")).filter("__ref IS NOT NULL")
    meant = names.groupBy(*page, "__ref").agg(F.min_by(F.struct("element_id", F.expr("__able AND NOT __banner").alias("ok")), "seq").alias("__e"))
    refs = segments.select(*page, "seg_seq", F.posexplode("element_refs").alias("__i", "__ref"))
    named = refs.join(meant, [*page, "__ref"]).filter("__e.ok").groupBy(*page, "seg_seq").agg(F.min_by("__e.element_id", "__i").alias("element_id"))
    head = F.substring(stripped(F.coalesce("text", F.lit(""))), 1, 6)
    heads = known.filter(F.expr("__able AND kind <> 'title'")).select(*page, "seq", "element_id", "importance", head.alias("__key")).filter(F.length("__key") >= 2)
    best = F.struct((-F.col("importance")).alias("i"), "seq", "element_id", "__key")
    on_page = heads.groupBy(*page).agg(F.array_sort(F.collect_list(best)).alias("__heads"), F.collect_set(F.length("__key")).alias("__sizes"))
    on_page = on_page.withColumn("__heads", F.when(F.size("__heads") <= FEW, F.col("__heads")))  # many don't go to each sentence
    rest = segments.join(named, [*page, "seg_seq"], "left_anti").select(*page, "seg_seq", "text").join(on_page, page)
    first = F.get(F.filter("__heads", lambda h: F.position(h["__key"], F.col("text")) > 0), F.lit(0))["__key"]
    runs = F.flatten(F.array(*[F.when(F.array_contains("__sizes", n), windows(F.col("text"), n)).otherwise(F.array().cast("array<string>")) for n in range(2, 7)]))
    keys = F.when(F.col("__heads").isNotNull(), F.array_compact(F.array(first))).otherwise(runs)
    said = rest.select(*page, "seg_seq", F.explode(keys).alias("__key")).join(heads, [*page, "__key"])
    said = said.groupBy(*page, "seg_seq").agg(F.min_by("element_id", F.struct(-F.col("importance"), F.col("seq"))).alias("element_id"))
    return named.unionByName(said)


def targets_on_pages(pages: DataFrame, refs: Column) -> DataFrame:
    """DIR-5 for pages that hold their ``elements`` and ``sentences`` (``seg_seq, text, start, end``): each sentence with a target, with
    its ``start, end`` and the ``target`` as a struct (``element_id, kind, importance, w, h, text``, of it 64 characters), beside the other
    columns of pages.

    ``refs`` are a sentence's references, of the columns ``page_index`` and ``seg_seq``. All is looked up in the page's row, so no text moves; pages with
    over ``FEW`` elements go through ``resolve_targets``, where the sentences of a page don't meet each of them.
    """
    page = ["project_id", "page_index"]
    rest = [c for c in pages.columns if c not in ("elements", "sentences")]

    def shown(get: Callable[[str], Column]) -> list[Column]:
        return [*[get(c).alias(c) for c in ("element_id", "kind", "importance", "w", "h")], F.substring(get("text"), 1, 64).alias("text")]

    def known(e: Column) -> Column:
        get = lambda c: e[c]
        head = F.substring(stripped(F.coalesce(e["text"], F.lit(""))), 1, 6)
        able, banner = worth_pointing_at(get), is_banner("title", get)
        return F.struct(e["seq"].alias("seq"), e["label"].alias("label"), able.alias("able"), banner.alias("banner"), head.alias("head"), F.struct(*shown(get)).alias("target"))

    rows = pages.withColumn("__known", F.transform("elements", known))
    begins = F.filter("__known", lambda e: e["able"] & (e["target"]["kind"] != "title") & (F.length(e["head"]) >= 2))
    heads = F.array_sort(F.transform(begins, lambda e: F.struct((-e["target"]["importance"]).alias("i"), e["seq"].alias("seq"), e["head"].alias("head"), e["target"].alias("target"))))
    rows = rows.withColumn("__heads", heads)
    said = rows.filter(F.size("__heads") <= FEW).select(*rest, "__known", "__heads", F.inline("sentences"))
    meant = F.transform(refs, lambda r: F.get(F.filter("__known", lambda e: (e["target"]["element_id"] == r) | (e["label"] == r)), F.lit(0)))
    named = F.get(F.filter(meant, lambda e: e["able"] & ~e["banner"]), F.lit(0))["target"]
    begun = F.get(F.filter("__heads", lambda h: F.position(h["head"], F.col("text")) > 0), F.lit(0))["target"]
    found = said.select(*rest, "seg_seq", "start", "end", F.coalesce(named, begun).alias("target")).filter("target IS NOT NULL")

    many = rows.filter(F.size("__heads") > FEW)
    e, s = many.select(*page, "title", F.inline("elements")), many.select(*page, F.inline("sentences"))
    joined = resolve_targets(s.withColumn("element_refs", refs), e).join(s.drop("text"), [*page, "seg_seq"])
    joined = joined.join(e.select(*page, "element_id", F.struct(*shown(F.col)).alias("target")), [*page, "element_id"]).join(many.select(*rest), page)
    return found.unionByName(joined.select(found.columns))


def action_budget(seconds: Column) -> Column:
    """DIR-8: an action for every six seconds, 2 to 8, rounded half to even."""
    return F.greatest(F.lit(2), F.least(F.lit(8), F.bround(seconds / 6, 0).cast("int")))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """DIR-9: the best candidates of each scene, as many as its ``budget``; none on covers and section pages.

    ``candidates`` have ``importance, emphasis, in_flow, page_type, budget``.
    """
    score = F.col("importance") + F.when(F.col("emphasis"), 0.5).otherwise(0.0) + F.when(F.col("in_flow"), 0.3).otherwise(0.0)
    rows = candidates.filter(~F.col("page_type").isin(*SIGNPOSTS)).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("project_id", "page_index").orderBy(F.desc("score"), "seg_seq"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= F.col("budget"))


def drop_stutter(chosen: DataFrame) -> DataFrame:
    """DIR-10: without a target that is the same as the one before, in the order of sentences."""
    order = Window.partitionBy("project_id", "page_index").orderBy("seg_seq")
    rows = chosen.withColumn("__before", F.lag("element_id").over(order))
    return rows.filter(~F.col("element_id").eqNullSafe(F.col("__before"))).drop("__before")
