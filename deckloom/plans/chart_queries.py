"""Queries over plots, inherited attributes and styles, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.operators import charts
from deckloom.plans import fixtures
from deckloom.plans.fixtures import with_ctes
from deckloom.plans.review_queries import points

TAGS = ("barChart", "bar3DChart", "lineChart", "areaChart", "pieChart", "scatterChart", "surface3DChart")
TYPES = ("title", "body", "obj", "pic")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a plot group of its customer's chart; its fields pick the tag, the direction and the axis."""
    o = fixtures.table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    tag = F.element_at(F.array(*[F.lit(t) for t in TAGS]), (n % len(TAGS) + 1).cast("int"))
    axis = F.when(n % 5 != 0, F.concat(F.lit("a"), (n % 3).cast("string")))
    return o.select(
        F.lit("deck").alias("project_id"), F.col("o_custkey").alias("chart_id"), n.alias("group_no"), tag.alias("tag"), F.when(n % 2 == 0, "bar").otherwise("col").alias("bar_dir"),
        F.when(n % 4 == 0, "stacked").when(n % 4 == 1, "percentStacked").alias("grouping"), (n % 3 == 0).alias("markers"), axis.alias("axis_id"),
    )


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of two of the three axes of each chart."""
    g = groups(spark, sf_dir).filter("axis_id in ('a0', 'a1')").select("project_id", "chart_id", "axis_id").distinct()
    return g.withColumns({"low": F.lit(0.0), "high": F.col("chart_id").cast("double")})


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of sales: one reading lacks some names, values and series; the other has them."""
    p = points(spark, sf_dir).groupBy("project_id", "chart_id", "series_no").agg(F.array_sort(F.collect_list("value")).alias("points"))
    n = F.col("series_no") + F.length("chart_id")
    none = F.array().cast("array<double>")
    a = p.filter(n % 5 != 0).select("project_id", "chart_id", "series_no", F.when(n % 2 == 0, "own").alias("name"), F.when(n % 3 == 0, none).otherwise(F.col("points")).alias("points"), F.when(n % 4 == 0, "#111111").alias("color"))
    b = p.filter(n % 7 != 0).select("project_id", "chart_id", "series_no", F.when(n % 3 == 0, "xml").otherwise("").alias("name"), F.slice("points", 1, 2).alias("points"), F.when(n % 3 == 1, "#222222").alias("color"), F.when(n % 2 == 0, "line").otherwise("bar").alias("kind"))
    palette = spark.range(1, 7).select(F.lit("deck").alias("project_id"), F.col("id").cast("int").alias("slot"), F.concat(F.lit("accent"), F.col("id").cast("string")).alias("color"))
    kinds = p.select("project_id", "chart_id").distinct().withColumn("kind", F.lit("bar"))
    m = charts.merge_series(a, b, palette, kinds)
    return m.select("chart_id", "series_no", "name", "color", "kind", F.size("points").alias("n"))


def scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even series are stacked, the fifth has an axis of its own; charts with long names declare some of their bounds."""
    p = points(spark, sf_dir).withColumns({"stacked": F.col("series_no") % 2 == 0, "secondary": F.col("series_no") == 5})
    n = F.length("chart_id")
    declared = p.select(*charts.CHART).distinct().withColumns({"y_min": F.when(n > 6, -1000.0), "y_max": F.when(n % 3 == 0, 7e7), "y2_min": F.lit(None).cast("double"), "y2_max": F.when(n > 7, 5e6)})
    return charts.axis_scale(p, declared=declared)


def inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event sets an attribute of its user's shape; every third sets nothing."""
    e = fixtures.stage_events(spark, sf_dir)
    value = F.when(F.col("k") % 3 != 0, F.when(F.col("k") % 7 == 0, "").otherwise(F.col("k").cast("string")))
    return charts.resolve_inheritance(e.select(F.col("project_id").alias("shape_id"), (F.col("k") % 9).alias("level"), F.col("stage").alias("attr"), (F.col("k") % 5).alias("precedence"), value.alias("value")))


def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as shapes; those of a document's first page stand for its layout."""
    e = fixtures.elements(spark, sf_dir)
    kind = lambda k: F.element_at(F.array(*[F.lit(t) for t in TYPES]), (k % len(TYPES) + 1).cast("int"))
    c = e.filter("page_index = 1").select(F.col("project_id").alias("layout_id"), "seq", (F.col("seq") * 2).alias("idx"), kind(F.length("text")).alias("ph_type"), F.col("element_id").alias("candidate"))
    s = e.select(F.col("project_id").alias("layout_id"), F.col("element_id").alias("shape_id"), F.when(F.col("seq") % 3 != 0, F.col("seq")).alias("idx"), kind(F.col("seq") + F.col("page_index")).alias("ph_type"))
    return charts.match_placeholder(s, c)


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's tables by segment, in small letters; styles of two segments of a nation; the first is its default."""
    c = fixtures.table(spark, sf_dir, "customer")
    ids = c.select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("table_id"), F.lower("c_mktsegment").alias("style_id"))
    s = fixtures.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.explode(F.array(F.lit("BUILDING"), F.lit("Machinery"))).alias("style_id"), "n_name")
    s = s.select("project_id", "style_id", F.concat("n_name", F.lit("/"), "style_id").alias("style"))
    d = fixtures.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.when(F.col("n_nationkey") % 2 == 0, "building").alias("default_id"))
    return charts.lookup_style(ids, s, d)


QUERIES = {
    "ch2_kinds": lambda spark, sf_dir: groups(spark, sf_dir).select("group_no", charts.series_kind().alias("kind")),
    "ch3_axes": lambda spark, sf_dir: charts.assign_axes(groups(spark, sf_dir), axes(spark, sf_dir)),
    "ch4_series": merged,
    "ch7_numbers": lambda spark, sf_dir: fixtures.stage_events(spark, sf_dir).select("event_id", charts.fmt_number(F.when(F.col("k") % 3 == 0, F.floor(F.col("duration_s") * 100).cast("double")).when(F.col("k") % 3 == 1, F.col("duration_s") / 1000).otherwise(F.col("duration_s"))).alias("said")),
    "ch8_scale": scale,
    "ch9_inherited": inherited,
    "ch10_placeholders": placeholders,
    "ch11_styles": styles,
}

fixtures.CTES |= {
    "plots": f"""
SELECT o_orderkey AS n, o_custkey AS chart_id, {list(TAGS)}[(o_orderkey % {len(TAGS)} + 1)::INT] AS tag, CASE WHEN o_orderkey % 5 <> 0 THEN 'a' || (o_orderkey % 3) END AS axis_id FROM orders
""",
}
_KIND = lambda i: f"{list(TYPES)}[(({i}) % {len(TYPES)} + 1)::INT]"
SQL = {
    "ch2_kinds": with_ctes(
        "plots",
        """
SELECT n AS group_no, CASE WHEN n % 4 <= 1 AND base IN ('column', 'bar', 'area') THEN base || '_stacked' WHEN n % 4 > 1 AND base = 'line' AND n % 3 = 0 THEN 'line_markers' ELSE base END AS kind
FROM (SELECT n, CASE WHEN tag LIKE 'bar%' THEN CASE WHEN n % 2 = 0 THEN 'bar' ELSE 'column' END WHEN tag <> 'surface3DChart' THEN replace(tag, 'Chart', '') END AS base FROM plots)""",
    ),
    "ch3_axes": with_ctes(
        "plots",
        """
SELECT 'deck' AS project_id, chart_id, n AS group_no, axis_id IS NOT NULL AND axis_id <> first AS secondary, CASE WHEN axis_id IN ('a0', 'a1') THEN 0 END::DOUBLE AS y_min,
  CASE WHEN axis_id IN ('a0', 'a1') THEN chart_id END::DOUBLE AS y_max, tag IN ('bar3DChart', 'surface3DChart') AS solid
FROM (SELECT *, arg_min(axis_id, n) FILTER (axis_id IS NOT NULL) OVER (PARTITION BY chart_id) AS first FROM plots)""",
    ),
    "ch4_series": with_ctes(
        "points",
        """
SELECT chart_id, series_no, coalesce(CASE WHEN n % 5 <> 0 AND n % 2 = 0 THEN 'own' END, CASE WHEN n % 7 <> 0 AND n % 3 = 0 THEN 'xml' END, '系列 ' || (series_no + 1)) AS name,
  coalesce(CASE WHEN n % 5 <> 0 AND n % 4 = 0 THEN '#111111' END, CASE WHEN n % 7 <> 0 AND n % 3 = 1 THEN '#222222' END, 'accent' || (series_no % 6 + 1)) AS color,
  CASE WHEN n % 7 <> 0 AND n % 2 = 0 THEN 'line' END AS kind, CASE WHEN n % 5 <> 0 AND n % 3 <> 0 THEN size ELSE least(size, 2) END::INT AS n
FROM (SELECT chart_id, series_no, series_no + length(chart_id) AS n, count(value) AS size FROM points GROUP BY ALL)
WHERE size > 0 AND (n % 7 <> 0 OR n % 5 <> 0 AND n % 3 <> 0)""",
    ),
    "ch7_numbers": with_ctes(
        "stage_events",
        """
SELECT event_id, CASE WHEN abs(v) < 1 AND v <> 0 THEN format('{:,.0f}%', v * 100) WHEN v = floor(v) THEN format('{:,.0f}', v) ELSE format('{:,.1f}', v) END AS said
FROM (SELECT event_id, CASE k % 3 WHEN 0 THEN floor(duration_s * 100) WHEN 1 THEN duration_s / 1000 ELSE duration_s END::DOUBLE AS v FROM stage_events)""",
    ),
    "ch8_scale": with_ctes(
        "points",
        """
, sides AS (
  SELECT *, 'primary' AS axis FROM (SELECT *, bool_and(series_no = 5) OVER (PARTITION BY chart_id) AS alone FROM points) WHERE series_no <> 5 OR alone
  UNION ALL SELECT *, true, 'secondary' AS axis FROM points WHERE series_no = 5
), every AS (
  SELECT chart_id, axis, sum(coalesce(value, 0)) AS v FROM sides WHERE series_no % 2 = 0 GROUP BY chart_id, axis, cat_idx
  UNION ALL SELECT chart_id, axis, value FROM sides WHERE series_no % 2 = 1 AND value IS NOT NULL
), ends AS (
  SELECT chart_id, axis, CASE WHEN axis = 'primary' AND length(chart_id) > 6 THEN -1000 ELSE least(0, coalesce(min(v), 0)) END::DOUBLE AS a,
    CASE WHEN axis = 'primary' AND length(chart_id) % 3 = 0 THEN 7e7 WHEN axis = 'secondary' AND length(chart_id) > 7 THEN 5e6 ELSE greatest(0, coalesce(max(v), 1)) END::DOUBLE AS b
  FROM (SELECT DISTINCT chart_id, axis FROM sides) LEFT JOIN every USING (chart_id, axis) GROUP BY chart_id, axis
),
sized AS (SELECT *, (b - a) / 4 AS raw, pow(10.0::DOUBLE, floor(log10(CASE WHEN b > a THEN (b - a) / 4 ELSE 1 END))) AS size FROM ends),
stepped AS (
  SELECT *, CASE WHEN a = b THEN CASE WHEN b = 0 THEN 1 ELSE b END / 4 ELSE size * CASE WHEN raw / size >= 5 THEN 10 WHEN raw / size >= 2 THEN 5 WHEN raw / size >= 1 THEN 2 ELSE 1 END END::DOUBLE AS step FROM sized
)
SELECT 'deck' AS project_id, chart_id, axis, CASE WHEN a = b THEN 0 ELSE floor(a / step) * step END::DOUBLE AS low, CASE WHEN a = b THEN CASE WHEN b = 0 THEN 1 ELSE b END ELSE ceil(b / step) * step END::DOUBLE AS high, step FROM stepped""",
    ),
    "ch9_inherited": with_ctes(
        "stage_events",
        """
SELECT project_id AS shape_id, k % 9 AS level, stage AS attr, max({'p': k % 5, 'v': CASE WHEN k % 7 = 0 THEN '' ELSE k::VARCHAR END}).v AS value FROM stage_events WHERE k % 3 <> 0 GROUP BY project_id, k % 9, stage""",
    ),
    "ch10_placeholders": with_ctes(
        "elements",
        f"""
, c AS (SELECT project_id AS layout_id, seq, seq * 2 AS idx, {_KIND("length(text)")} AS ph_type, element_id AS candidate FROM elements WHERE page_index = 1)
, s AS (SELECT project_id AS layout_id, element_id AS shape_id, CASE WHEN seq % 3 <> 0 THEN seq END AS idx, {_KIND("seq + page_index")} AS ph_type FROM elements)
SELECT layout_id, shape_id, s.idx, s.ph_type, arg_min(candidate, CASE WHEN s.idx = c.idx THEN 0 ELSE 1000 END + c.seq)
  FILTER (s.idx = c.idx OR s.ph_type = c.ph_type OR s.ph_type IN ('body', 'obj') AND c.ph_type IN ('body', 'obj')) AS candidate
FROM s JOIN c USING (layout_id) GROUP BY ALL""",
    ),
    "ch11_styles": """
SELECT c_nationkey AS project_id, c_custkey AS table_id, lower(c_mktsegment) AS style_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN n_name || '/BUILDING' WHEN 'MACHINERY' THEN n_name || '/Machinery' ELSE CASE WHEN c_nationkey % 2 = 0 THEN n_name || '/BUILDING' END END AS style
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}
