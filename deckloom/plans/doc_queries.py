"""Queries over pages and elements of decks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.functions.text import looks_like_bullet, looks_numeric, truncate_clause
from deckloom.operators import document
from deckloom.plans import fixtures
from deckloom.plans.fixtures import with_ctes

PAGE = ["project_id", "page_index"]


def raw_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, some of them images by their text's length; labels are a text's first 8 characters."""
    e = fixtures.elements(spark, sf_dir).withColumn("is_image", F.length("text") % 11 == 5)
    return e.withColumn("label", F.substring("text", 1, 8))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.classify_elements(raw_elements(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    return document.page_titles(e).join(document.page_text(e), PAGE)


def typed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.typed_pages(elements(spark, sf_dir))


def _of_elements(f):
    return lambda spark, sf_dir: f(elements(spark, sf_dir))


def _of_pages(f):
    return lambda spark, sf_dir: f(typed_pages(spark, sf_dir))


def scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.elements(spark, sf_dir)
    b = e.select(*PAGE, "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w") / 32).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    return document.scale_boxes(b, 2.0, 12)


def tests_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.elements(spark, sf_dir)
    return e.select("project_id", "page_index", "seq", looks_like_bullet(F.col("text")).alias("bullet"), looks_numeric(F.col("text")).alias("numeric"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.elements(spark, sf_dir)
    s = e.select(*PAGE, "seq", (F.col("seq") - 1).alias("placeholder"), (F.length("text") % 3).alias("paragraphs"), (F.length("text") % 2).alias("level"))
    return document.classify_shapes(s).select(*PAGE, "seq", "kind", "importance")


def promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    e = e.withColumn("kind", F.when(F.col("kind") == "title", "paragraph").otherwise(F.col("kind")))
    return document.promote_titles(e).select(*PAGE, "seq", "kind", "importance")


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines as a table: three words of a line are its cells."""
    e = fixtures.elements(spark, sf_dir)
    cells = e.select("project_id", F.lit(1).alias("page_index"), F.lit("t1").alias("element_id"), ((F.col("page_index") - 1) * 8 + F.col("seq") - 1).alias("row"), F.posexplode(F.slice(F.split("text", " "), 1, 3)).alias("col", "text"))
    return document.table_text(cells)


def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_elements(spark, sf_dir)
    refs = e.select(*PAGE, F.col("element_id").alias("ref")).unionByName(e.select(*PAGE, F.col("label").alias("ref"))).distinct()
    return document.resolve_elements(refs, e)


def merged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer that saw the first six pages, keeps the odd ones backwards and names a page that isn't there."""
    p = typed_pages(spark, sf_dir)
    order = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("page_index")))
    answer = p.filter("page_index <= 6 and page_index % 2 = 1").select("project_id", order.alias("place"), "page_index")
    ghost = p.select("project_id").distinct().select("project_id", F.lit(99).alias("place"), F.lit(999).alias("page_index"))
    return document.merge_order(answer.unionByName(ghost), p, p.filter("page_index <= 6"))


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = typed_pages(spark, sf_dir)
    some = F.when(F.col("project_id").cast("long") % 2 == 0, F.reverse("page_order")).otherwise(F.array().cast("array<int>"))
    return document.ordered_pages(document.presentation_order(p).withColumn("page_order", some), p)


def understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = typed_pages(spark, sf_dir).withColumn("summary", F.substring("raw_text", 1, 20))
    a = p.filter("page_index % 2 = 0").select(*PAGE, F.lit("case").alias("page_type"), F.when(F.col("page_index") % 4 == 0, "New").otherwise("").alias("title"), F.lit("").alias("summary"))
    return document.merge_understanding(p, a).select(*PAGE, "page_type", "title", "summary")


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    s = e.filter("seq % 2 = 0").select(*PAGE, "element_id", (F.col("font_size") / 10 - 0.5).alias("importance"))
    return document.merge_importance(e, s).select(*PAGE, "element_id", "importance")


def rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.elements(spark, sf_dir)
    p = e.select(*PAGE).distinct().withColumns({"width": F.when(F.col("page_index") % 5 == 0, 0.0).otherwise(1920.0), "height": F.lit(1080.0)})
    dims = p.select(*PAGE, F.when(F.col("page_index") % 3 == 0, 1920.0).otherwise(960.0).alias("width"), F.when(F.col("page_index") % 3 == 0, 1080.0).otherwise(540.0).alias("height"))
    return document.rescale_pages(e, p, dims).select(*PAGE, "seq", "x", "y", "w", "h")


def diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a shape; each but the last of a page has a connector to the next, every fourth to itself."""
    e = fixtures.elements(spark, sf_dir)
    s = e.select(*PAGE, F.col("seq").alias("shape_id"), "text")
    c = e.select(*PAGE, F.col("seq").alias("edge_seq"), F.col("seq").alias("start_shape"), F.when(F.col("seq") % 4 == 0, F.col("seq")).otherwise(F.col("seq") + 1).alias("end_shape"))
    return document.diagram_edges(s, e, c)


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.flow_order(diagram(spark, sf_dir))


def flow_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.flow_text(flow(spark, sf_dir), raw_elements(spark, sf_dir))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.elements(spark, sf_dir).select(*PAGE, "seq", truncate_clause(F.col("text"), 60).alias("cut"))


QUERIES = {
    "doc2_scale_boxes": scale,
    "doc3_classify": lambda spark, sf_dir: elements(spark, sf_dir).select(*PAGE, "seq", "kind", "importance"),
    "doc4_text_tests": tests_of_text,
    "doc5_shapes": shapes,
    "doc6_promote": promote,
    "doc7_titles": _of_elements(document.page_titles),
    "doc8_page_text": _of_elements(document.page_text),
    "doc9_table_text": table_cells,
    "doc11_resolve": resolve,
    "doc12_page_types": _of_pages(lambda p: p.select(*PAGE, "page_type")),
    "doc13_key_points": _of_elements(document.key_points),
    "doc14_truncate": clauses,
    "doc15_sections": _of_pages(document.build_sections),
    "doc16_rollup": _of_pages(document.deck_rollup),
    "doc17_order": _of_pages(document.presentation_order),
    "doc18_merge_order": merged_order,
    "doc19_ordered_pages": ordered,
    "doc20_understanding": understanding,
    "doc20_importance": importance,
    "doc21_visual_batches": lambda spark, sf_dir: document.visual_batches(typed_pages(spark, sf_dir), elements(spark, sf_dir)),
    "doc22_rescale": rescale,
    "doc23_diagram": diagram,
    "doc24_flow_order": flow,
    "doc25_flow_text": flow_words,
    "doc26_census": _of_elements(document.element_census),
}

fixtures.CTES |= {
    "sized": """
SELECT e.*, length(text) % 11 = 5 AS is_image, substr(text, 1, 8) AS label, sizes
FROM elements e JOIN (
  SELECT project_id, page_index, list_sort(list(font_size) FILTER (length(text) % 11 <> 5)) AS sizes
  FROM elements GROUP BY project_id, page_index
) USING (project_id, page_index)
""",
    "classified": r"""
SELECT *, CASE kind WHEN 'title' THEN 0.9 WHEN 'subtitle' THEN 0.7 WHEN 'bullet' THEN 0.6 WHEN 'number' THEN 0.8 ELSE 0.5 END::DOUBLE AS importance
FROM (
  SELECT * EXCLUDE (sizes), CASE WHEN is_image THEN 'image'
    WHEN font_size >= sizes[len(sizes)] - 0.5 THEN 'title'
    WHEN font_size > sizes[len(sizes) // 2 + 1] * 1.15 THEN 'subtitle'
    WHEN regexp_matches(text, '^\s*[•\-·▪◦*]') THEN 'bullet'
    WHEN length(trim(text)) BETWEEN 1 AND 24 AND len(regexp_extract_all(text, '[0-9]')) >= greatest(1, 0.35 * length(trim(text))) THEN 'number'
    ELSE 'paragraph' END AS kind
  FROM sized
)
""",
    "pages_of": """
SELECT project_id, page_index,
  coalesce(arg_min(text, seq) FILTER (kind = 'title' AND text <> ''), arg_min(substr(text, 1, 60), seq) FILTER (text <> ''), '') AS title,
  trim(string_agg(text, chr(10) ORDER BY seq)) AS raw_text,
  max((kind = 'chart')::INT) AS chart, max((kind = 'image')::INT) AS image, count(*) AS n
FROM classified GROUP BY project_id, page_index
""",
    "typed": """
SELECT *, CASE WHEN page_index = 1 THEN 'cover'
  WHEN regexp_matches(head, '目录|议程|contents|agenda|outline') THEN 'agenda'
  WHEN regexp_matches(head, '联系|contact|微信|电话|email|邮箱') THEN 'contact'
  WHEN regexp_matches(head, '总结|小结|结论|summary|conclusion|thank') OR page_index = max(page_index) OVER (PARTITION BY project_id) THEN 'summary'
  WHEN regexp_matches(head, '架构|architecture|技术方案|系统|流程') THEN 'architecture'
  WHEN chart = 1 THEN 'chart' WHEN image = 1 AND n <= 3 THEN 'section' ELSE 'content' END AS page_type
FROM (SELECT *, lower(title || ' ' || substr(raw_text, 1, 200)) AS head FROM pages_of)
""",
    "edges": """
SELECT c.project_id, c.page_index, c.seq AS edge_seq, s.first AS source, t.first AS target
FROM elements c
JOIN named s ON s.project_id = c.project_id AND s.page_index = c.page_index AND s.seq = c.seq
JOIN named t ON t.project_id = c.project_id AND t.page_index = c.page_index AND t.seq = CASE WHEN c.seq % 4 = 0 THEN c.seq ELSE c.seq + 1 END
WHERE s.first <> t.first
QUALIFY count(*) OVER (PARTITION BY c.project_id, c.page_index) >= 2
""",
    "named": """
SELECT project_id, page_index, seq, first_value(element_id) OVER (PARTITION BY project_id, page_index, trim(text) ORDER BY seq) AS first
FROM elements WHERE trim(text) <> ''
""",
    "graphs": """
SELECT *, list_filter(nodes, lambda x : len(list_filter(e, lambda y : y.t = x)) = 0) AS ready
FROM (
  SELECT project_id, page_index, e, list_filter(ends, lambda x, i : list_position(ends, x) = i) AS nodes
  FROM (SELECT project_id, page_index, list({'s': source, 't': target} ORDER BY edge_seq) AS e, flatten(list([source, target] ORDER BY edge_seq)) AS ends FROM edges GROUP BY ALL)
)
""",
    "walk": """
SELECT project_id, page_index, e, nodes, ready, []::VARCHAR[] AS done FROM graphs
UNION ALL
SELECT project_id, page_index, e, nodes, list_concat(ready[2:], list_transform(list_filter(range(1, len(outs) + 1), lambda i :
    NOT list_contains(list_transform(outs[i + 1:], lambda y : y.t), outs[i].t) AND len(list_filter(e, lambda f : f.t = outs[i].t AND NOT list_contains(seen, f.s))) = 0), lambda i : outs[i].t)), seen
FROM (SELECT *, list_filter(e, lambda x : x.s = ready[1]) AS outs, list_append(done, ready[1]) AS seen FROM walk WHERE len(ready) > 0)
""",
    "flows": """
SELECT project_id, page_index, unnest(range(1, len(nodes) + 1))::INT AS place, unnest(list_concat(done, list_filter(nodes, lambda x : NOT list_contains(done, x)))) AS node
FROM walk WHERE len(ready) = 0
""",
}
fixtures.NEEDS |= {"sized": ["elements"], "classified": ["sized"], "pages_of": ["classified"], "typed": ["pages_of"], "named": ["elements"], "edges": ["named"], "graphs": ["edges"], "walk": ["graphs"], "flows": ["walk"]}

_CUT = """CASE WHEN length({c}) <= 60 THEN {c} ELSE coalesce(
  substr({c}, 1, list_filter(range(59, 29, -1), lambda i : contains('。；;，,、！？!?)）】」', substr({c}, (i + 1)::BIGINT, 1))
    AND NOT (substr({c}, (i + 1)::BIGINT, 1) IN (',', '，', '.') AND regexp_matches(substr({c}, i::BIGINT, 1), '[0-9]') AND regexp_matches(substr({c}, (i + 2)::BIGINT, 1), '[0-9]')))[1] + 1),
  substr({c}, 1, list_filter(range(59, 29, -1), lambda i : substr({c}, (i + 1)::BIGINT, 1) = ' ')[1]),
  substr({c}, 1, 60)) END"""

SQL = {
    "doc2_scale_boxes": with_ctes(
        "elements",
        "SELECT * FROM (SELECT project_id, page_index, seq, x * 2 AS x, y * 2 AS y, (x + w / 32) * 2 - x * 2 AS w, (y + h) * 2 - y * 2 AS h FROM elements) WHERE w >= 12 AND h >= 12",
    ),
    "doc3_classify": with_ctes("classified", "SELECT project_id, page_index, seq, kind, importance FROM classified"),
    "doc4_text_tests": with_ctes(
        "elements",
        r"""
SELECT project_id, page_index, seq, regexp_matches(text, '^\s*[•\-·▪◦*]') AS bullet,
  length(trim(text)) BETWEEN 1 AND 24 AND len(regexp_extract_all(text, '[0-9]')) >= greatest(1, 0.35 * length(trim(text))) AS numeric
FROM elements""",
    ),
    "doc5_shapes": with_ctes(
        "elements",
        """
SELECT project_id, page_index, seq, CASE WHEN seq = 1 THEN 'title' WHEN length(text) % 3 > 1 OR length(text) % 2 > 0 THEN 'bullet' ELSE 'paragraph' END AS kind,
  CASE WHEN seq = 1 THEN 0.9 WHEN length(text) % 3 > 1 OR length(text) % 2 > 0 THEN 0.6 ELSE 0.5 END::DOUBLE AS importance
FROM elements""",
    ),
    "doc6_promote": with_ctes(
        "classified",
        """
SELECT project_id, page_index, seq, CASE WHEN up THEN 'title' ELSE kind END AS kind, CASE WHEN up THEN 0.9 ELSE importance END AS importance
FROM (
  SELECT *, able AND row_number() OVER (PARTITION BY project_id, page_index ORDER BY able DESC, font_size DESC, y, seq) = 1 AS up
  FROM (SELECT * REPLACE (CASE kind WHEN 'title' THEN 'paragraph' ELSE kind END AS kind), kind IN ('title', 'paragraph', 'bullet') AS able FROM classified)
)""",
    ),
    "doc7_titles": with_ctes("pages_of", "SELECT project_id, page_index, title FROM pages_of"),
    "doc8_page_text": with_ctes("pages_of", "SELECT project_id, page_index, raw_text FROM pages_of"),
    "doc9_table_text": with_ctes(
        "elements",
        """
SELECT project_id, 1 AS page_index, 't1' AS element_id,
  string_agg(array_to_string(string_split(text, ' ')[1:3], ' | '), chr(10) ORDER BY page_index, seq) AS text
FROM elements WHERE (page_index - 1) * 8 + seq - 1 < 12 GROUP BY project_id""",
    ),
    "doc11_resolve": with_ctes(
        "sized",
        """
SELECT r.project_id, r.page_index, r.ref, arg_min(e.element_id, e.seq) AS element_id
FROM (
  SELECT project_id, page_index, element_id AS ref FROM sized
  UNION SELECT project_id, page_index, label FROM sized
) r JOIN sized e ON e.project_id = r.project_id AND e.page_index = r.page_index AND (e.element_id = r.ref OR e.label = r.ref)
GROUP BY r.project_id, r.page_index, r.ref""",
    ),
    "doc12_page_types": with_ctes("typed", "SELECT project_id, page_index, page_type FROM typed"),
    "doc13_key_points": with_ctes(
        "classified",
        f"""
SELECT project_id, page_index, (list({_CUT.format(c='line')} ORDER BY seq))[1:4] AS key_points
FROM (
  SELECT *, rank = min(rank) OVER (PARTITION BY project_id, page_index) AS best
  FROM (
    SELECT project_id, page_index, seq, CASE WHEN kind IN ('bullet', 'number', 'chart') THEN 0 ELSE 1 END AS rank,
      CASE WHEN kind IN ('bullet', 'number', 'chart') THEN trim(text, ' •-·*' || chr(9)) ELSE trim(text) END AS line
    FROM classified WHERE kind IN ('bullet', 'number', 'chart', 'paragraph', 'subtitle')
  ) WHERE CASE WHEN rank = 0 THEN length(line) >= 2 ELSE line <> '' END
) WHERE best GROUP BY project_id, page_index""",
    ),
    "doc14_truncate": with_ctes("elements", f"SELECT project_id, page_index, seq, {_CUT.format(c='text')} AS cut FROM elements"),
    "doc15_sections": with_ctes(
        "typed",
        """
SELECT project_id, section_no, arg_min(CASE WHEN title = '' THEN '第 ' || page_index || ' 部分' ELSE title END, page_index) AS title,
  list(page_index ORDER BY page_index) AS page_indexes
FROM (
  SELECT *, sum(CASE WHEN page_type IN ('cover', 'agenda', 'section') OR first THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY page_index)::INT AS section_no
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY page_index) = 1 AS first FROM typed)
) GROUP BY project_id, section_no""",
    ),
    "doc16_rollup": with_ctes(
        "typed",
        """
SELECT project_id, coalesce((list(title ORDER BY page_index) FILTER (title <> ''))[1], '') AS topic,
  coalesce(string_agg(title, '、' ORDER BY page_index) FILTER (title <> '' AND place <= 3), '') AS summary,
  coalesce((list(title ORDER BY page_index) FILTER (title <> ''))[1:8], []) AS concepts
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY page_index) AS place FROM typed) GROUP BY project_id""",
    ),
    "doc17_order": with_ctes("typed", "SELECT project_id, coalesce(list(page_index ORDER BY page_index) FILTER (page_type <> 'contact'), []) AS page_order FROM typed GROUP BY project_id"),
    "doc18_merge_order": with_ctes(
        "typed",
        """
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY late, CASE WHEN late THEN page_index ELSE -page_index END)::INT AS place, page_index
FROM (
  SELECT project_id, page_index, false AS late FROM typed WHERE page_index <= 6 AND page_index % 2 = 1
  UNION ALL SELECT project_id, page_index, true FROM typed WHERE page_index > 6 AND page_type <> 'contact'
)""",
    ),
    "doc19_ordered_pages": with_ctes(
        "typed",
        """
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN even THEN -page_index ELSE page_index END)::INT AS place, page_index
FROM (
  SELECT *, project_id::BIGINT % 2 = 0 AND bool_or(page_type <> 'contact') OVER (PARTITION BY project_id) AS even FROM typed
) WHERE NOT even OR page_type <> 'contact'""",
    ),
    "doc20_understanding": with_ctes(
        "typed",
        """
SELECT project_id, page_index, CASE WHEN page_index % 2 = 0 THEN 'case' ELSE page_type END AS page_type,
  CASE WHEN page_index % 4 = 0 THEN 'New' ELSE title END AS title, substr(raw_text, 1, 20) AS summary FROM typed""",
    ),
    "doc20_importance": with_ctes(
        "classified",
        "SELECT project_id, page_index, element_id, CASE WHEN seq % 2 = 0 THEN greatest(0, least(1, font_size / 10 - 0.5)) ELSE importance END AS importance FROM classified",
    ),
    "doc21_visual_batches": with_ctes(
        "typed",
        """
SELECT project_id, page_index, batch, weight, rank
FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, batch ORDER BY weight DESC, page_index)::INT AS rank
  FROM (
    SELECT t.project_id, t.page_index, ((row_number() OVER (PARTITION BY t.project_id ORDER BY t.page_index) - 1) // 6)::INT AS batch,
      (coalesce(drawn, 0) + CASE WHEN length(raw_text) < 80 THEN 1 ELSE 0 END + CASE WHEN page_type = 'architecture' THEN 1.5 ELSE 0 END)::DOUBLE AS weight
    FROM typed t LEFT JOIN (
      SELECT project_id, page_index, sum(CASE kind WHEN 'chart' THEN 2 WHEN 'image' THEN 1.5 WHEN 'table' THEN 0.5 ELSE 0 END) AS drawn
      FROM classified GROUP BY project_id, page_index
    ) d ON d.project_id = t.project_id AND d.page_index = t.page_index
  )
) WHERE rank <= 4""",
    ),
    "doc22_rescale": with_ctes(
        "elements",
        """
SELECT project_id, page_index, seq, x * f AS x, y * f AS y, w * f AS w, h * f AS h
FROM (SELECT *, CASE WHEN page_index % 3 = 0 OR page_index % 5 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS f FROM elements)""",
    ),
    "doc24_flow_order": with_ctes("flows", "SELECT * FROM flows").replace("WITH ", "WITH RECURSIVE ", 1),
    "doc25_flow_text": with_ctes(
        "flows",
        """
SELECT f.project_id, f.page_index, string_agg(said, ' → ' ORDER BY place) AS flow
FROM flows f JOIN (SELECT project_id, page_index, element_id, coalesce(nullif(trim(text), ''), element_id) AS said FROM elements) e ON e.project_id = f.project_id AND e.page_index = f.page_index AND e.element_id = f.node
GROUP BY f.project_id, f.page_index""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "doc23_diagram": with_ctes("edges", "SELECT * FROM edges"),
    "doc26_census": with_ctes(
        "classified",
        "SELECT kind, sum(n)::BIGINT AS n, count(*) AS pages FROM (SELECT kind, project_id, page_index, count(*) AS n FROM classified GROUP BY ALL) GROUP BY kind",
    ),
}
