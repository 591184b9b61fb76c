"""Chart facts: dense series, trends and shares in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["project_id", "chart_id", "series_no"]


def densify_series(points: DataFrame) -> DataFrame:
    """CH-1: one row for each index from 0 to the largest; a missing value is null, a missing category empty."""
    size = points.groupBy(*SERIES).agg(F.greatest(F.max("cat_idx") + 1, F.max(F.coalesce("pt_count", F.lit(0)))).alias("n"))
    every = size.filter("n > 0").select(*SERIES, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("cat_idx"))
    rows = every.join(points.select(*SERIES, "cat_idx", "category", "value"), [*SERIES, "cat_idx"], "left")
    return rows.withColumn("category", F.coalesce("category", F.lit("")))


def describe_series(points: DataFrame, flat: float = 0.05) -> DataFrame:
    """CH-5: ``first, last, peak, peak_category, trend, change`` over the values that are there.

    A change under 5 % is flat, and then no peak is told; from a first value of 0 it is just ``changed``. A peak is told if
    it exceeds both ends by 5 %. One value alone has no trend, change or peak.
    """
    rows = points.filter("value is not null")
    found = rows.groupBy(*SERIES).agg(
        F.min_by("value", "cat_idx").alias("first"),
        F.max_by("value", "cat_idx").alias("last"),
        F.max("value").alias("__peak"),
        F.count("*").alias("__n"),
        F.min_by("category", F.struct(-F.col("value"), F.col("cat_idx"))).alias("__at"),
    )
    ratio = (F.col("last") - F.col("first")) / F.nullif(F.abs("first"), F.lit(0.0))
    ratio = F.when(F.col("__n") > 1, ratio)
    trend = F.when(F.col("__n") == 1, None).when(ratio.isNull(), "changed").when(F.abs(ratio) < flat, "flat").when(ratio > 0, "up").otherwise("down")
    tells = (F.col("trend") != "flat") & (F.col("__peak") > 1.05 * F.greatest("first", "last"))
    found = found.withColumns({"trend": trend, "change": F.round(ratio * 100, 0).cast("int")})
    return found.withColumns({"peak": F.when(tells, F.col("__peak")), "peak_category": F.when(tells, F.col("__at"))}).drop("__peak", "__at", "__n")


def describe_shares(points: DataFrame, top: int = 3) -> DataFrame:
    """CH-6: the largest three values of the first series as whole percents of the sum of sizes."""
    first = Window.partitionBy("project_id", "chart_id")
    rows = points.withColumn("__s", F.min("series_no").over(first)).filter("series_no = __s")
    size = F.abs(F.coalesce("value", F.lit(0.0)))
    rows = rows.withColumns({"size": size, "__all": F.sum(size).over(first)}).filter("__all > 0")
    rank = F.row_number().over(first.orderBy(F.desc("size"), "cat_idx"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= top)
    return rows.select("project_id", "chart_id", "rank", "category", F.round(100 * F.col("size") / F.col("__all"), 0).cast("int").alias("percent"))


def fmt_number(c: Column) -> Column:
    """CH-7: a fraction as percent, a whole number with thousands, others with one decimal."""
    whole = c == F.floor(c)
    percent = F.concat(F.format_number(c * 100, 0), F.lit("%"))
    return F.when((F.abs(c) < 1) & (c != 0), percent).when(whole, F.format_number(c, 0)).otherwise(F.format_number(c, 1))


# Plots --------------------------------------------------------------------------------------------------------------

# Kinds of plots by the tag of their group, and their stacked variants.
GROUP_KINDS = {
    "barChart": "column", "bar3DChart": "column", "lineChart": "line", "line3DChart": "line", "areaChart": "area", "area3DChart": "area",
    "pieChart": "pie", "pie3DChart": "pie", "ofPieChart": "pie", "doughnutChart": "doughnut", "scatterChart": "scatter", "bubbleChart": "scatter",
}
STACKED = {"column": "column_stacked", "bar": "bar_stacked", "area": "area_stacked"}
SOLID = ("bar3DChart", "line3DChart", "area3DChart", "pie3DChart", "surface3DChart")
CHART = ["project_id", "chart_id"]


def _lookup(words: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), key)


def series_kind() -> Column:
    """CH-2: the kind of a plot group ``tag, bar_dir, grouping, markers``; null for a tag that isn't known."""
    base = _lookup(GROUP_KINDS, F.col("tag"))
    base = F.when((base == "column") & (F.col("bar_dir") == "bar"), "bar").otherwise(base)
    stacked = F.col("grouping").isin("stacked", "percentStacked")
    return F.when(stacked, F.coalesce(_lookup(STACKED, base), base)).when((base == "line") & F.col("markers"), "line_markers").otherwise(base)


def assign_axes(groups: DataFrame, axes: DataFrame) -> DataFrame:
    """CH-3: ``secondary, y_min, y_max, solid`` of each group ``group_no, axis_id, tag``: the first group's axis is the
    primary one, any other that is named is secondary; bounds come from the axis itself."""
    order = Window.partitionBy(*CHART).orderBy("group_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = groups.withColumn("__first", F.first("axis_id", ignorenulls=True).over(order))
    rows = rows.join(axes.select(*CHART, "axis_id", F.col("low").alias("y_min"), F.col("high").alias("y_max")), [*CHART, "axis_id"], "left")
    secondary = F.col("axis_id").isNotNull() & (F.col("axis_id") != F.col("__first"))
    return rows.select(*CHART, "group_no", secondary.alias("secondary"), "y_min", "y_max", F.col("tag").isin(*SOLID).alias("solid"))


def merge_series(reader: DataFrame, xml: DataFrame, palette: DataFrame, charts: DataFrame) -> DataFrame:
    """CH-4: series of two readings, matched by place: the first one's name, values and colour, each filled from the second,
    then from a number and the palette's ``slot`` (1 to 6, in turn). Series without values are dropped; the kind is kept
    only where it differs from the chart's."""
    key = [*CHART, "series_no"]
    other = xml.select(*key, F.col("name").alias("__n"), F.col("points").alias("__v"), F.col("color").alias("__c"), "kind")
    rows = reader.select(*key, "name", "points", "color").join(other, key, "full")
    rows = rows.withColumn("slot", F.pmod("series_no", F.lit(6)) + 1).join(palette.select("project_id", "slot", F.col("color").alias("__p")), ["project_id", "slot"], "left")
    rows = rows.join(charts.select(*CHART, F.col("kind").alias("__k")), CHART, "left")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    full = lambda c: F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<double>"))) > 0, F.col(c))
    name = F.coalesce(text("name"), text("__n"), F.format_string("系列 %d", F.col("series_no") + 1))
    rows = rows.select(
        *key, name.alias("name"), F.coalesce(full("points"), full("__v")).alias("points"), F.coalesce(text("color"), text("__c"), F.col("__p")).alias("color"),
        F.when(~F.col("kind").eqNullSafe(F.col("__k")), F.col("kind")).alias("kind"),
    )
    return rows.filter("points is not null")


def axis_scale(points: DataFrame, ticks: int = 4, declared: DataFrame | None = None) -> DataFrame:
    """CH-8: ``axis, low, high, step`` of a chart's axes: stacked series summed by category, others by value, always with 0;
    steps are 1, 2, 5 or 10 times a power of ten.

    ``points`` have ``stacked, cat_idx, value`` and may have ``secondary``: such series have an axis of their own, and all
    series set the primary one where none is left for it. Bounds of ``declared`` (``y_min, y_max, y2_min, y2_max``, null where
    there is none) win over computed ones.
    """
    if "secondary" not in points.columns:
        points = points.withColumn("secondary", F.lit(False))
    chart = Window.partitionBy(*CHART)
    second = F.coalesce("secondary", F.lit(False))
    rows = points.withColumn("__none", F.min(second.cast("int")).over(chart) == 1)
    axes = F.filter(F.array(F.when(~second | F.col("__none"), "primary"), F.when(second, "secondary")), lambda a: a.isNotNull())
    rows, key = rows.withColumn("axis", F.explode(axes)), [*CHART, "axis"]
    sums = rows.filter("stacked").groupBy(*key, "cat_idx").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value")).drop("cat_idx")
    every = sums.unionByName(rows.filter("not stacked and value is not null").select(*key, "value"))
    ends = rows.select(*key).distinct().join(every.groupBy(*key).agg(F.min("value").alias("__a"), F.max("value").alias("__b")), key, "left")
    low, high = F.least(F.lit(0.0), F.coalesce("__a", F.lit(0.0))), F.greatest(F.lit(0.0), F.coalesce("__b", F.lit(1.0)))
    if declared is not None:
        ends = ends.join(declared.select(*CHART, "y_min", "y_max", "y2_min", "y2_max"), CHART, "left")
        of = lambda end: F.when(F.col("axis") == "primary", F.col(f"y_{end}")).otherwise(F.col(f"y2_{end}")).cast("double")
        low, high = F.coalesce(of("min"), low), F.coalesce(of("max"), high)
    rows = ends.select(*key, low.alias("__low"), high.alias("__high"))
    raw = (F.col("__high") - F.col("__low")) / ticks
    size = F.pow(F.lit(10.0), F.floor(F.log10(F.when(raw == 0, 1.0).otherwise(F.abs(raw)))))
    unit = F.when(raw / size >= 5, 10.0).when(raw / size >= 2, 5.0).when(raw / size >= 1, 2.0).otherwise(1.0)
    flat, top = F.col("__low") == F.col("__high"), F.when(F.col("__high") == 0, 1.0).otherwise(F.col("__high"))
    rows = rows.withColumn("step", F.when(flat, top / ticks).otherwise(unit * size))
    edge = lambda c, f: f(F.col(c) / F.col("step")) * F.col("step")
    return rows.select(*key, F.when(flat, 0.0).otherwise(edge("__low", F.floor)).alias("low"), F.when(flat, top).otherwise(edge("__high", F.ceil)).alias("high"), "step")


# Inheritance --------------------------------------------------------------------------------------------------------

# Kinds of placeholders that stand in for each other.
BODY_FAMILY = ("body", "subTitle", "obj", "tbl", "chart", "dgm", "media", "clipArt")


def resolve_inheritance(attrs: DataFrame) -> DataFrame:
    """CH-9: the value of each shape's attribute at each level: the one of the highest ``precedence`` that isn't null; an
    empty text is a value. Among equals the greatest."""
    given = attrs.filter("value is not null")
    return given.groupBy("shape_id", "level", "attr").agg(F.max_by("value", F.struct("precedence", "value")).alias("value"))


def match_placeholder(shapes: DataFrame, candidates: DataFrame) -> DataFrame:
    """CH-10: ``candidate``: the placeholder of a layout that governs a shape ``idx, ph_type``: the first of the same index,
    else the first of the same type or, for both in the body family, any; null if none. A layout has few placeholders."""
    c = candidates.select("layout_id", "seq", F.col("idx").alias("__idx"), F.col("ph_type").alias("__type"), "candidate")
    same = F.col("idx").eqNullSafe(F.col("__idx")) & F.col("idx").isNotNull()
    kin = (F.col("ph_type") == F.col("__type")) | (F.col("ph_type").isin(*BODY_FAMILY) & F.col("__type").isin(*BODY_FAMILY))
    tier = F.when(same, 1).when(kin, 2)
    hits = shapes.join(c, "layout_id").withColumn("__tier", tier).filter("__tier is not null")
    best = hits.groupBy("layout_id", "shape_id").agg(F.min_by("candidate", F.struct("__tier", "seq")).alias("candidate"))
    return shapes.join(best, ["layout_id", "shape_id"], "left")


def lookup_style(ids: DataFrame, styles: DataFrame, defaults: DataFrame) -> DataFrame:
    """CH-11: the style that a table names, whatever its case, else the project's default, else null."""
    known = styles.select("project_id", F.upper("style_id").alias("__id"), F.col("style").alias("__own"))
    standard = defaults.join(styles.withColumn("__u", F.upper("style_id")), (defaults["project_id"] == styles["project_id"]) & (F.upper("default_id") == F.col("__u")))
    standard = standard.select(defaults["project_id"], F.col("style").alias("__std"))
    rows = ids.withColumn("__id", F.upper("style_id")).join(known, ["project_id", "__id"], "left").join(standard, "project_id", "left")
    return rows.withColumn("style", F.coalesce("__own", "__std")).drop("__id", "__own", "__std")
