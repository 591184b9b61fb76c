"""Queries over paragraphs, names, prompts, replies, placeholder scripts and spoken forms, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.operators import drafts, narration
from deckloom.plans import fixtures
from deckloom.plans.caption_queries import _recursive
from deckloom.plans.doc_queries import _CUT, elements, raw_elements, typed_pages
from deckloom.plans.fixtures import with_ctes
from deckloom.plans.narration_queries import budget, budget_of, intents, kept, segments
from deckloom.plans.review_queries import LATIN_TICS, scenes
from deckloom.sources.shared import stored

PAGE = ["project_id", "page_index"]


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as blocks ten points apart; every fourth length is set in, every ninth an image."""
    e = fixtures.elements(spark, sf_dir)
    n = F.length("text")
    b = e.select(*PAGE, F.col("seq").alias("block_seq"), F.when(n % 9 == 0, 1).otherwise(0).alias("type"), (F.col("x") + F.when(n % 4 == 0, 5.0).otherwise(0.0)).alias("x0"), F.col("y").alias("y0"),
                 (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + 100.0).alias("y1"), F.col("font_size").alias("max_size"), "text")
    return drafts.join_paragraphs(b)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_elements(spark, sf_dir).select(*PAGE, "seq", drafts.element_name(F.col("page_index"), F.col("seq"), F.when(F.col("seq") % 5 != 0, F.substring("text", 1, 30))).alias("name"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = typed_pages(spark, sf_dir).withColumn("speaker_notes", F.when(F.col("page_index") % 2 == 0, F.col("title")))
    p = p.join(narration.narration_guide(budget(spark, sf_dir)).select(*PAGE, "chars"), PAGE)
    n = F.col("doc_id")
    decks = fixtures.table(spark, sf_dir, "documents").select(n.cast("string").alias("project_id"), F.when(n % 3 != 0, F.col("source")).alias("title"))
    return drafts.prompt_batches(p, elements(spark, sf_dir), 4, 120, decks)


def script_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for the pages without a text; every third deck has no title, every fifth page a flow, every second notes."""
    title = F.when(F.col("title") != "", F.col("title"))
    p = typed_pages(spark, sf_dir).withColumns({"flow": F.when(F.col("page_index") % 5 == 0, title), "summary": title, "speaker_notes": F.when(F.col("page_index") % 2 == 0, title)})
    p = p.withColumn("key_points", F.when(F.col("page_index") % 3 == 0, F.array(F.lit("a"), F.col("page_type"))))
    p = p.join(narration.narration_guide(budget(spark, sf_dir)).select(*PAGE, "chars"), PAGE)
    n = F.col("doc_id")
    d = fixtures.table(spark, sf_dir, "documents").select(
        n.cast("string").alias("project_id"), F.when(n % 3 != 0, F.col("source")).alias("title"), F.col("lang").alias("topic"), F.lit("").alias("summary"), F.lit("all").alias("audience"),
        F.when(n % 2 == 0, "plain").otherwise("x").alias("style"), F.lit("calm").alias("tone"), F.when(n % 7 == 0, "short").alias("instructions"),
    )
    return drafts.narration_prompts(p, elements(spark, sf_dir), d, kept(spark, sf_dir))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's language and number as the title of an object: plain, fenced, in prose, with stray quotes, cut off or a
    list."""
    d = fixtures.table(spark, sf_dir, "documents")
    t = F.concat("lang", F.col("doc_id").cast("string"))
    good = F.concat(F.lit('{"title": "'), t, F.lit('", "n": '), F.col("doc_id").cast("string"), F.lit("}"))
    n = F.col("doc_id") % 6
    reply = F.when(n == 0, good).when(n == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Here it is: "), good, F.lit(" Done.")))
    reply = reply.when(n == 3, F.concat(F.lit('{"title": "a "'), t, F.lit('" b", "n": 1}'))).when(n == 4, F.concat(F.lit('{"title": "'), t)).otherwise(F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]")))
    got = drafts.salvage_json(d.select("doc_id", reply.alias("reply")), "reply", "title string, n bigint")
    return got.select("doc_id", "parsed.title", "parsed.n", "error")


def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's key points are the beginnings of its lines; every third page has none, but a summary."""
    p = stored(typed_pages(spark, sf_dir), "pages")
    guide = narration.narration_guide(budget_of(p, intents(spark, sf_dir)))
    points = F.filter(F.split("raw_text", "\n"), lambda t: t != "")
    p = p.withColumns({"key_points": F.when(F.col("page_index") % 3 == 0, F.array().cast("array<string>")).otherwise(points), "speaker_notes": F.when(F.col("page_index") % 4 == 1, F.col("raw_text")), "summary": F.col("title")})
    return drafts.placeholder_script(p, elements(spark, sf_dir), guide)


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.create_map(F.lit("The"), F.lit("thee"), F.lit("and"), F.lit("n"), F.lit("la"), F.lit("l a"))
    return segments(spark, sf_dir).select(*PAGE, "seg_seq", drafts.for_speech(F.col("text"), terms).alias("spoken"))


QUERIES = {
    "doc1_paragraphs": paragraphs,
    "doc10_names": names,
    "doc27_prompts": prompts,
    "doc27_script_prompts": script_prompts,
    "doc28_replies": replies,
    "nar12_placeholders": placeholders,
    "nar17_spoken": spoken,
    "rev9_tics": lambda spark, sf_dir: drafts.check_tics(scenes(spark, sf_dir), LATIN_TICS),
}

#: The cut at 60 characters, at 300 and at 120.
_CUT_300 = _CUT.replace("29", "149").replace("59", "299").replace("60", "300")
_CUT_120 = _CUT.replace("60", "120").replace("59", "119").replace("29", "59")
#: White space as one space, cut at {n}.
_FLAT = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
_SHORT = f"CASE WHEN length({_FLAT}) <= {{n}} THEN {_FLAT} ELSE substr({_FLAT}, 1, {{n}} - 1) || '…' END"
fixtures.CTES |= {
    "blocks": """
SELECT project_id, page_index, seq AS block_seq, (length(text) % 9 = 0)::INT AS type, x + CASE WHEN length(text) % 4 = 0 THEN 5 ELSE 0 END AS x0, y AS y0, x + w AS x1, y + 100 AS y1, font_size AS max_size, text FROM elements
""",
    "joined": """
SELECT *, block_seq AS at_seq FROM blocks WHERE block_seq = 1
UNION ALL
SELECT p.project_id, p.page_index, CASE WHEN goes THEN p.block_seq ELSE b.block_seq END, b.type, CASE WHEN goes THEN least(p.x0, b.x0) ELSE b.x0 END, CASE WHEN goes THEN least(p.y0, b.y0) ELSE b.y0 END,
  CASE WHEN goes THEN greatest(p.x1, b.x1) ELSE b.x1 END, CASE WHEN goes THEN greatest(p.y1, b.y1) ELSE b.y1 END, CASE WHEN goes THEN greatest(p.max_size, b.max_size) ELSE b.max_size END,
  CASE WHEN goes THEN p.text || chr(10) || b.text ELSE b.text END, b.block_seq
FROM joined p JOIN blocks b ON b.project_id = p.project_id AND b.page_index = p.page_index AND b.block_seq = p.at_seq + 1,
  LATERAL (SELECT p.type = 0 AND b.type = 0 AND abs(p.x0 - b.x0) <= 4 AND b.y0 - p.y1 BETWEEN 0 AND greatest(p.max_size, b.max_size) * 0.9::DOUBLE
    AND abs(p.max_size - b.max_size) <= greatest(p.max_size, b.max_size) * 0.15::DOUBLE AND least(p.x1 - p.x0, b.x1 - b.x0) >= 0.35::DOUBLE * greatest(p.x1 - p.x0, b.x1 - b.x0) AS goes)
""",
}
fixtures.NEEDS |= {"blocks": ["elements"], "joined": ["blocks"]}
_OPEN = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(drafts.TRANSITIONS))
SQL = {
    "doc1_paragraphs": _recursive("joined", "SELECT * EXCLUDE (at_seq) FROM joined QUALIFY row_number() OVER (PARTITION BY project_id, page_index, block_seq ORDER BY at_seq DESC) = 1"),
    "doc10_names": with_ctes(
        "elements",
        r"""
SELECT project_id, page_index, seq, element_id || CASE WHEN seq % 5 = 0 THEN '' ELSE '_' || substr(trim(regexp_replace(lower(regexp_replace(strip_accents(substr(text, 1, 30)), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_'), 1, 24) END AS name FROM elements""",
    ),
    "doc27_prompts": with_ctes(
        "budgets",
        f"""
, lines AS (
  SELECT project_id, page_index, string_agg('  - ' || element_id || '｜' || kind || '｜' || {_CUT_120.format(c="trim(text)")}, chr(10) ORDER BY seq) AS l FROM classified WHERE text <> '' GROUP BY ALL
), parts AS (
  SELECT t.project_id, t.page_index, count(*) OVER (PARTITION BY t.project_id) AS n, (row_number() OVER (PARTITION BY t.project_id ORDER BY t.page_index) - 1) // 4 AS batch,
    concat_ws(chr(10), printf('## 第 %d 页｜%s', t.page_index, CASE WHEN title = '' THEN '（空）' ELSE title END), printf('字数预算：%d 字（%d–%d）', c, floor(c * 0.85::DOUBLE)::INT, floor(c * 1.15::DOUBLE)::INT),
      CASE WHEN t.page_index % 2 = 0 AND title <> '' THEN '演讲者备注：' || {_CUT_300.format(c="trim(title)")} END, CASE WHEN l IS NOT NULL THEN '元素：' || chr(10) || l ELSE '（这一页没有可提取的文字，请看配图）' END) AS p
  FROM typed t JOIN (SELECT project_id, page_index, floor(budget * 4.6::DOUBLE)::INT AS c FROM budgets) b ON b.project_id = t.project_id AND b.page_index = t.page_index
  LEFT JOIN lines l ON l.project_id = t.project_id AND l.page_index = t.page_index
)
SELECT project_id, batch::INT AS batch, printf('# 文档：%s（共 %d 页）', CASE WHEN any_value(doc_id) % 3 <> 0 THEN any_value(source) ELSE '未命名' END, any_value(n)) || chr(10) || chr(10) || '# 本批页面' || chr(10) || chr(10)
  || string_agg(p, chr(10) || chr(10) ORDER BY page_index) AS prompt FROM parts JOIN documents ON doc_id::VARCHAR = project_id GROUP BY project_id, batch""",
    ),
    "doc27_script_prompts": with_ctes(
        "budgets written",
        f"""
, lines AS (
  SELECT project_id, page_index, string_agg('  - ' || element_id || '｜' || kind || '｜' || {_SHORT.format(c="text", n=120)}, chr(10) ORDER BY seq) AS l FROM classified WHERE text <> '' GROUP BY ALL
), pages_told AS (
  SELECT t.*, b.c, l, nullif(w.narration, '') AS said, count(*) OVER (PARTITION BY t.project_id) AS all_pages, row_number() OVER (PARTITION BY t.project_id ORDER BY t.page_index) AS i
  FROM typed t JOIN (SELECT project_id, page_index, floor(budget * 4.6::DOUBLE)::INT AS c FROM budgets) b ON b.project_id = t.project_id AND b.page_index = t.page_index
  LEFT JOIN lines l ON l.project_id = t.project_id AND l.page_index = t.page_index LEFT JOIN written w ON w.project_id = t.project_id AND w.page_index = t.page_index
), placed AS (
  SELECT *, (i - 1) // 4 AS batch, count(said) OVER (PARTITION BY project_id) > 0 AS part,
    max(CASE WHEN said IS NOT NULL THEN page_index END) OVER (PARTITION BY project_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back,
    min(CASE WHEN said IS NOT NULL THEN page_index END) OVER (PARTITION BY project_id ORDER BY page_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fore,
    printf('%s## 第 %d 页｜%s｜%s', chr(10), page_index, page_type, CASE WHEN title = '' THEN '无标题' ELSE title END) AS heading,
    concat_ws(chr(10), CASE WHEN page_index % 5 = 0 AND title <> '' THEN printf('{drafts.FLOW}', title) END, printf('{drafts.BAND}', c, floor(c * 0.85::DOUBLE)::INT, floor(c * 1.15::DOUBLE)::INT),
      CASE WHEN title <> '' THEN '页面摘要：' || title END, CASE WHEN page_index % 3 = 0 THEN '关键点：a；' || page_type END,
      CASE WHEN page_index % 2 = 0 AND title <> '' THEN '演讲者备注：' || {_SHORT.format(c="title", n=300)} END, '元素：' || chr(10) || l) AS asked
  FROM pages_told
), batches AS (
  SELECT project_id, batch, any_value(all_pages) AS all_pages, min(i) AS i, any_value(part) AS part, (list(back ORDER BY page_index))[1] AS back, (list(fore ORDER BY page_index DESC))[1] AS fore,
    string_agg(heading || CASE WHEN said IS NOT NULL THEN '｜已写好' WHEN part THEN '｜待补写' ELSE '' END || chr(10) || coalesce('已写好的讲稿：' || said, asked), chr(10) ORDER BY page_index) AS p
  FROM placed GROUP BY project_id, batch HAVING NOT bool_and(said IS NOT NULL)
)
SELECT b.project_id, batch::INT AS batch, concat_ws(chr(10), '# 文档：' || CASE WHEN doc_id % 3 <> 0 THEN source ELSE '未命名' END, '主题：' || lang, '整体摘要：（无）', '', '# 观众与风格', '受众：all', '风格：' || CASE WHEN doc_id % 2 = 0 THEN 'plain' ELSE 'x' END,
  '语气：calm', '额外要求：' || CASE WHEN doc_id % 7 = 0 THEN 'short' ELSE '（无）' END, '', CASE WHEN part THEN '{drafts.FILL_IN}' END,
  printf('# 上文（第 %d 页，已写好，结尾）', back) || chr(10) || CASE WHEN length(x.narration) <= 200 THEN x.narration ELSE '…' || right(x.narration, 200) END || chr(10), printf('# 下文（第 %d 页，已写好，开头）', fore) || chr(10) || {_SHORT.format(c="y.narration", n=200)} || chr(10),
  printf('# 页面（全文第 %d 页起，共 %d 页）', i, all_pages), p) AS prompt
FROM batches b JOIN documents d ON d.doc_id::VARCHAR = b.project_id LEFT JOIN written x ON x.project_id = b.project_id AND x.page_index = back LEFT JOIN written y ON y.project_id = b.project_id AND y.page_index = fore""",
    ),
    "doc28_replies": """
SELECT doc_id, CASE WHEN doc_id % 6 <= 2 THEN lang || doc_id WHEN doc_id % 6 = 3 THEN 'a "' || lang || doc_id || '" b' END AS title, CASE WHEN doc_id % 6 <= 2 THEN doc_id WHEN doc_id % 6 = 3 THEN 1 END AS n,
  CASE doc_id % 6 WHEN 4 THEN '{"title": "' || lang || doc_id WHEN 5 THEN '[' || doc_id || ']' END AS error FROM documents""",
    "nar12_placeholders": with_ctes(
        "budgets",
        f"""
, opened AS (
  SELECT t.project_id, t.page_index, t.title, t.raw_text, b.chars, CASE WHEN t.page_index % 3 = 0 THEN [] ELSE list_transform(list_filter(string_split(t.raw_text, chr(10)), lambda x : x <> ''), lambda x : x) END AS points,
    replace(CASE WHEN page_type = 'cover' THEN '{drafts.COVER_LINE}' ELSE CASE (row_number() OVER (PARTITION BY t.project_id ORDER BY t.page_index) - 1) % 5 {_OPEN} END END, '%s', CASE WHEN title = '' THEN '第 ' || t.page_index || ' 页' ELSE title END) AS line
  FROM typed t JOIN (SELECT project_id, page_index, floor(budget * 4.6::DOUBLE)::INT AS chars FROM budgets) b ON b.project_id = t.project_id AND b.page_index = t.page_index
), pointed AS (
  SELECT project_id, page_index, chars, i, point, length(line) + sum(length(point) + 1) OVER (PARTITION BY project_id, page_index ORDER BY i) AS upto
  FROM (SELECT *, unnest(points) AS point, unnest(range(1, len(points) + 1)) AS i FROM opened)
), taken AS (SELECT * FROM pointed WHERE upto - length(point) - 1 < chars),
room AS (
  SELECT o.*, coalesce(k, 0) AS k, substr(replace(trim(raw_text, ' ' || chr(10)), chr(10), ''), 1, greatest(0, chars - coalesce(used, length(line)))::BIGINT) AS note
  FROM opened o LEFT JOIN (SELECT project_id, page_index, count(*) AS k, max(upto) AS used FROM taken GROUP BY ALL) u ON u.project_id = o.project_id AND u.page_index = o.page_index
), noted AS (SELECT *, page_index % 4 = 1 AND length(note) >= 6 AS has FROM room)
SELECT project_id, page_index, 1 AS segment_no, line AS text, NULL AS target FROM opened
UNION ALL SELECT t.project_id, t.page_index, (t.i + 1)::INT, point || '。', coalesce((list(e.element_id ORDER BY e.importance DESC, e.seq) FILTER (contains(e.text, substr(point, 1, 8))))[1], (list(e.element_id ORDER BY e.importance DESC, e.seq))[1])
FROM taken t JOIN classified e ON e.project_id = t.project_id AND e.page_index = t.page_index GROUP BY t.project_id, t.page_index, t.i, point
UNION ALL SELECT project_id, page_index, (k + 2)::INT, note || '。', NULL FROM noted WHERE has
UNION ALL SELECT project_id, page_index, 2, title || '。', NULL FROM noted WHERE NOT has AND k = 0 AND title <> ''""",
    ),
    "nar17_spoken": with_ctes(
        "segments",
        """
SELECT project_id, page_index, seg_seq, list_aggregate(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+]*|[^A-Za-z]+'), lambda x : CASE upper(x) WHEN 'THE' THEN 'thee' WHEN 'AND' THEN 'n' WHEN 'LA' THEN 'l a'
  WHEN 'RAG' THEN 'R A G' WHEN 'MOE' THEN 'M o E' WHEN 'ONNX' THEN 'O N N X' WHEN 'NER' THEN 'N E R' WHEN 'COT' THEN 'C o T' WHEN 'DAU' THEN 'D A U' WHEN 'MAU' THEN 'M A U' ELSE x END), 'string_agg', '') AS spoken FROM segments""",
    ),
    "rev9_tics": with_ctes("tics", "SELECT * FROM tics"),
}
