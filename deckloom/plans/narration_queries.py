"""Queries over budgets, scripts and timing, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.operators import document, narration
from deckloom.plans import fixtures
from deckloom.plans.doc_queries import elements, raw_elements, typed_pages
from deckloom.plans.fixtures import with_ctes
from deckloom.sources.shared import shared_path, stored

PAGE = ["project_id", "page_index"]
SILENCE = 2.1


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A length by the document's number; every fifth page is emphasised, every seventh skipped."""
    d = fixtures.table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("project_id"),
        (60 + F.col("doc_id") % 600).cast("int").alias("duration"),
        F.sequence(F.lit(5), F.lit(500), F.lit(5)).alias("emphasis_pages"),
        F.sequence(F.lit(7), F.lit(497), F.lit(7)).alias("skip_pages"),
    )


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_pages(spark, sf_dir).select(*PAGE, "title", "page_type", F.col("raw_text").alias("narration"), "raw_text")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages say; sentences and lengths need no titles and types, which would be joined in vain."""
    return document.page_text(raw_elements(spark, sf_dir)).withColumnRenamed("raw_text", "narration")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narration.split_segments(texts(spark, sf_dir), narration.SENTENCES_LATIN)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scripts(spark, sf_dir)
    return narration.build_scenes(s.drop("narration"), s.select(*PAGE, "narration"))


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_of(typed_pages(spark, sf_dir), intents(spark, sf_dir))


def budget_of(p: DataFrame, i: DataFrame) -> DataFrame:
    return narration.allocate_budget(p, i, SILENCE)


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for all pages, those of every third and fourth blank, and for a page that isn't there."""
    s = scripts(spark, sf_dir)
    text = F.when(F.col("page_index") % 3 == 0, "").when(F.col("page_index") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "narration"))
    ghost = s.select("project_id").distinct().select("project_id", F.lit(999).alias("page_index"), F.lit("x").alias("narration"))
    return s.select(*PAGE, text.alias("narration")).unionByName(ghost)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals_of(texts(spark, sf_dir))


def totals_of(t: DataFrame) -> DataFrame:
    return t.select(*PAGE, (F.length("narration") / 8.0).alias("total"))


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_pages(spark, sf_dir).select(*PAGE, F.concat(F.lit("About "), F.col("title")).alias("narration"))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narration.kept_pages(typed_pages(spark, sf_dir), written(spark, sf_dir))


def fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scripts(spark, sf_dir).select(*PAGE, "narration", (F.col("page_index") % 6 == 0).alias("frozen"))
    got = narration.fit_duration(d, budget(spark, sf_dir), intents(spark, sf_dir), silence=SILENCE, marks=narration.ENDS_LATIN)
    return got.select(*PAGE, F.length("narration").alias("chars"), "trimmed", "short")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.array(F.format_string("p%02d_e%02d", "page_index", F.col("seg_seq")), F.lit("ghost"))
    s = segments(spark, sf_dir).withColumn("element_refs", named)
    return narration.keep_known_refs(s, elements(spark, sf_dir)).select(*PAGE, "seg_seq", "element_refs")


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = narration.allocate_segments(segments(spark, sf_dir), totals(spark, sf_dir))
    return narration.time_segments(t.filter("page_index % 5 = 0"), t.filter("page_index % 3 = 0"), t)


def revoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scenes(spark, sf_dir)
    now = s.withColumn("fingerprint", narration.voice_fingerprint(F.col("narration"), "say", "v1", 1.0))
    old = s.filter("source_page % 4 <> 0").withColumn("narration", F.when(F.col("source_page") % 3 == 0, "old").otherwise(F.col("narration")))
    old = old.withColumn("fingerprint", narration.voice_fingerprint(F.col("narration"), "say", "v1", 1.0))
    old = old.withColumn("path", F.when(F.col("source_page") % 5 != 0, "a.wav"))
    return narration.scenes_to_voice(now, old)


def voice_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs: all scenes; every third page with a new script; nothing new; another voice. Recordings of every fifth page get lost."""
    table, parts = narration.voice_table(spark, shared_path(spark, "voice-table")), []
    s = stored(scenes(spark, sf_dir).select("project_id", "scene_id", "source_page", "narration"), "voice-scenes")
    for run in range(4):
        said = F.when((F.col("source_page") % 3 == 0) & F.lit(run > 0), F.concat("narration", F.lit(" new"))).otherwise(F.col("narration"))
        now = s.withColumns({"fingerprint": narration.voice_fingerprint(said, "say", "v2" if run == 3 else "v1", 1.0), "path": F.when(F.col("source_page") % 5 != 0, F.concat("scene_id", F.lit(".wav")))})
        parts.append(narration.voice_run(now, table, run).withColumn("run", F.lit(run)))
    return reduce(DataFrame.unionByName, parts)


def pauses_of(b: DataFrame) -> DataFrame:
    """Pauses at expected boundaries, shifted a little either way."""
    end = narration.thousandths(F.col("expected") + 0.15 * (F.col("seg_seq") % 3 - 1))
    return b.select(*PAGE, end.alias("end"), (0.2 + 0.1 * (F.col("seg_seq") % 4)).alias("duration"))


def unbroken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unbroken_of(segments(spark, sf_dir), totals(spark, sf_dir))


def unbroken_of(s: DataFrame, t: DataFrame) -> DataFrame:
    return narration.longest_unbroken(pauses_of(narration.expected_boundaries(s, t)), t.withColumnRenamed("total", "duration"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select(*PAGE, F.col("seg_seq").alias("unit_seq"), F.when(F.col("seg_seq") == 1, 0.0).otherwise(0.75).alias("gap"), (F.length("text") / 8.0).alias("duration"))
    return narration.unit_windows(s).select(*PAGE, "unit_seq", "start", "end")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scenes(spark, sf_dir)
    k = F.when(F.col("source_page") % 3 == 0, F.col("scene_id")).when(F.col("source_page") % 3 == 1, F.col("source_page").cast("string")).otherwise("nowhere")
    return narration.resolve_script_keys(s.select("project_id", k.alias("key")).distinct(), s)


def rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scenes(spark, sf_dir)
    e = s.filter("source_page % 2 = 0").select("project_id", "scene_id", F.when(F.col("source_page") % 4 == 0, " ").otherwise(" New words here. ").alias("narration"))
    return narration.rewrite_scenes(s, e).select("project_id", "scene_id", "narration", "duration")


QUERIES = {
    "nar1_budget": budget,
    "nar2_guide": lambda spark, sf_dir: narration.narration_guide(budget(spark, sf_dir)),
    "nar3_narratable": lambda spark, sf_dir: narration.narratable_pages(typed_pages(spark, sf_dir), intents(spark, sf_dir)).select(*PAGE),
    "nar4_estimate": lambda spark, sf_dir: scripts(spark, sf_dir).select(*PAGE, F.round(narration.estimate_duration(F.col("narration")), 6).alias("seconds")),
    "nar5_segments": segments,
    "nar6_scenes": scenes,
    "nar6_refs": refs,
    "nar7_adopt": lambda spark, sf_dir: narration.adopt_script(typed_pages(spark, sf_dir), written(spark, sf_dir), fallback(spark, sf_dir)),
    "nar8_kept": kept,
    "nar9_fill": lambda spark, sf_dir: narration.fill_missing(
        typed_pages(spark, sf_dir), written(spark, sf_dir).filter("page_index % 2 = 0"), kept(spark, sf_dir).filter("page_index % 2 = 1"), fallback(spark, sf_dir)
    ),
    "nar10_fit": fit,
    "nar13_nearest": lambda spark, sf_dir: narration.nearest_written(typed_pages(spark, sf_dir), kept(spark, sf_dir)),
    "nar14_batches": lambda spark, sf_dir: narration.narration_batches(typed_pages(spark, sf_dir), kept(spark, sf_dir)),
    "nar15_rewrite": rewrite,
    "nar16_keys": keys,
    "tim3_windows": windows,
    "tim4_allocate": lambda spark, sf_dir: narration.allocate_segments(segments(spark, sf_dir), totals(spark, sf_dir)),
    "tim5_boundaries": lambda spark, sf_dir: narration.expected_boundaries(segments(spark, sf_dir), totals(spark, sf_dir)),
    "tim7_ladder": ladder,
    "tim8_shift": lambda spark, sf_dir: narration.shift_segments(narration.allocate_segments(segments(spark, sf_dir), totals(spark, sf_dir))),
    "tim9_revoice": revoice,
    "tim9_runs": voice_runs,
    "tim10_unbroken": unbroken,
    "tim11_total": lambda spark, sf_dir: narration.total_duration(scenes(spark, sf_dir)),
}

_SECONDS = r"greatest(0.8, (len(regexp_extract_all({c}, '[一-鿿]')) / 4.6::DOUBLE + len(regexp_extract_all(regexp_replace({c}, '[一-鿿]', ' ', 'g'), '\S+')) / 2.6::DOUBLE) / 1.0)"

fixtures.CTES |= {
    "unbroken": """
WITH pauses AS (
  SELECT project_id, page_index, floor((floor(total * upto::DOUBLE / whole::DOUBLE * 1000 + 0.5) / 1000 + 0.15::DOUBLE * (seg_seq % 3 - 1)) * 1000 + 0.5) / 1000 AS e,
    0.2::DOUBLE + 0.1::DOUBLE * (seg_seq % 4) AS d FROM weighed WHERE NOT last
), marks AS (
  SELECT project_id, page_index, (greatest(e - d, 0) + e) / 2 AS moment FROM pauses
  UNION ALL SELECT project_id, page_index, 0 FROM typed UNION ALL SELECT project_id, page_index, length(raw_text) / 8.0::DOUBLE FROM typed
)
SELECT project_id, page_index, floor(max(step) * 1000 + 0.5) / 1000 AS longest
FROM (SELECT *, lead(moment) OVER (PARTITION BY project_id, page_index ORDER BY moment) - moment AS step FROM marks) GROUP BY project_id, page_index
""",
    "budgets": """
SELECT project_id, page_index, duration, emphasised, greatest(4.0, least(75.0, speech * w / sum(w) OVER (PARTITION BY project_id)))::DOUBLE AS budget
FROM (
  SELECT *, greatest(duration - 2.1::DOUBLE * count(*) OVER (PARTITION BY project_id), duration * 0.4::DOUBLE) AS speech,
    CASE page_type WHEN 'cover' THEN 0.35 WHEN 'agenda' THEN 0.45 WHEN 'section' THEN 0.4 WHEN 'chart' THEN 1.25 WHEN 'architecture' THEN 1.35
      WHEN 'summary' THEN 0.8 WHEN 'contact' THEN 0.25 ELSE 1.0 END::DOUBLE
      * (1 + least(length(raw_text), 600) / 600::DOUBLE) * CASE WHEN emphasised THEN 1.9 ELSE 1.0 END::DOUBLE AS w
  FROM (SELECT *, 60 + project_id::BIGINT % 600 AS duration, page_index % 5 = 0 AS emphasised FROM typed)
)
""",
    "segments": r"""
SELECT project_id, page_index, i::INT AS seg_seq, printf('scene_%02d_s%02d', page_index, i::INT) AS segment_id, parts[i] AS text
FROM (
  SELECT *, unnest(range(1, len(parts) + 1)) AS i
  FROM (
    SELECT project_id, page_index, list_filter(list_transform(
      string_split_regex(regexp_replace(raw_text, '([。！？!?；;.])\s*', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda x : trim(x)), lambda x : x <> '') AS parts
    FROM typed
  )
)
""",
    "scenes": f"""
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY page_index)::INT AS scene_seq,
  printf('scene_%02d', row_number() OVER (PARTITION BY project_id ORDER BY page_index)) AS scene_id, page_index AS source_page, title,
  raw_text AS narration, round({_SECONDS.format(c='raw_text')}, 3) AS duration
FROM typed
""",
    "written": """
SELECT project_id, page_index, CASE WHEN page_index % 4 = 0 OR page_index % 3 = 0 THEN '' ELSE trim(raw_text, ' ' || chr(10)) END AS narration FROM typed
""",
    "weighed": f"""
SELECT s.project_id, s.page_index, seg_seq, text, total, w, sum(w) OVER (PARTITION BY s.project_id, s.page_index ORDER BY seg_seq) AS upto,
  sum(w) OVER (PARTITION BY s.project_id, s.page_index) AS whole, seg_seq = max(seg_seq) OVER (PARTITION BY s.project_id, s.page_index) AS last
FROM (SELECT *, floor(greatest(0.05, {_SECONDS.format(c='text')}) * 1e6)::BIGINT AS w FROM segments) s
JOIN (SELECT project_id, page_index, length(raw_text) / 8.0::DOUBLE AS total FROM typed) t ON t.project_id = s.project_id AND t.page_index = s.page_index
""",
    "timed": """
SELECT project_id, page_index, seg_seq, floor(total * (upto - w)::DOUBLE / whole::DOUBLE * 1000 + 0.5) / 1000 AS start,
  CASE WHEN last THEN floor(total * 1000 + 0.5) / 1000 ELSE floor(total * upto::DOUBLE / whole::DOUBLE * 1000 + 0.5) / 1000 END AS "end"
FROM weighed WHERE total > 0
""",
}
fixtures.NEEDS |= {"unbroken": ["weighed", "typed"], "budgets": ["typed"], "segments": ["typed"], "scenes": ["typed"], "written": ["typed"], "weighed": ["segments"], "timed": ["weighed"]}

SQL = {
    "nar1_budget": with_ctes("budgets", "SELECT project_id, page_index, budget FROM budgets"),
    "nar2_guide": with_ctes(
        "budgets",
        "SELECT project_id, page_index, round(budget, 1) AS target_seconds, floor(budget * 4.6::DOUBLE)::INT AS chars, round(budget + 2.1::DOUBLE, 1) AS page_seconds FROM budgets",
    ),
    "nar3_narratable": with_ctes("typed", "SELECT project_id, page_index FROM typed WHERE page_index % 7 <> 0"),
    "nar4_estimate": with_ctes("typed", f"SELECT project_id, page_index, round({_SECONDS.format(c='raw_text')}, 6) AS seconds FROM typed"),
    "nar5_segments": with_ctes("segments", "SELECT * FROM segments"),
    "nar6_scenes": with_ctes("scenes", "SELECT * FROM scenes"),
    "nar6_refs": with_ctes(
        "segments elements",
        """
SELECT s.project_id, s.page_index, s.seg_seq, CASE WHEN e.seq IS NULL THEN [] ELSE [e.element_id] END AS element_refs
FROM segments s LEFT JOIN elements e ON e.project_id = s.project_id AND e.page_index = s.page_index AND e.seq = s.seg_seq""",
    ),
    "nar7_adopt": with_ctes(
        "written",
        """
SELECT t.project_id, t.page_index, coalesce(nullif(w.narration, ''), 'About ' || t.title) AS narration, nullif(w.narration, '') IS NULL AS missing
FROM typed t LEFT JOIN written w ON w.project_id = t.project_id AND w.page_index = t.page_index""",
    ),
    "nar8_kept": with_ctes("written", "SELECT * FROM written WHERE narration <> ''"),
    "nar9_fill": with_ctes(
        "written",
        """
SELECT t.project_id, t.page_index, coalesce(nullif(w.narration, ''), 'About ' || t.title) AS narration,
  CASE WHEN nullif(w.narration, '') IS NULL THEN 'fallback' WHEN t.page_index % 2 = 1 THEN 'kept' ELSE 'answer' END AS origin
FROM typed t LEFT JOIN written w ON w.project_id = t.project_id AND w.page_index = t.page_index""",
    ),
    "nar10_fit": with_ctes(
        "budgets",
        r"""
, parts AS (
  SELECT b.*, t.raw_text AS text, floor(budget * 4.6::DOUBLE)::BIGINT AS lim, length(t.raw_text) / 4.6::DOUBLE - budget AS excess,
    list_filter(string_split(regexp_replace(t.raw_text, '([。！？.!?])', '\1' || chr(1), 'g'), chr(1)), lambda x : trim(x, ' ' || chr(10)) <> '') AS parts
  FROM budgets b JOIN typed t ON t.project_id = b.project_id AND t.page_index = b.page_index
), cut AS (
  SELECT *, excess > 0 AND page_index % 6 <> 0 AS able,
    CASE WHEN length(text) <= lim OR len(parts) <= 1 THEN length(text)
      ELSE list_max(list_transform(range(1, len(parts) + 1), lambda i : CASE WHEN i = 1 OR length(array_to_string(parts[1:i], '')) <= lim THEN length(array_to_string(parts[1:i], '')) ELSE 0 END)) END AS short_chars
  FROM parts
), saved AS (
  SELECT *, CASE WHEN able THEN greatest(0, length(text) - short_chars) ELSE 0 END AS saving,
    excess * CASE WHEN emphasised THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS rank,
    sum(length(text)) OVER (PARTITION BY project_id) / 4.6::DOUBLE + 2.1::DOUBLE * count(*) OVER (PARTITION BY project_id) AS total
  FROM cut
), taken AS (
  SELECT *, total - coalesce(sum(saving) OVER (PARTITION BY project_id ORDER BY able DESC, rank DESC, page_index DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4.6::DOUBLE
    > duration * (1 + 0.1::DOUBLE) AND saving > 0 AS trimmed
  FROM saved
)
SELECT project_id, page_index, CASE WHEN trimmed THEN length(text) - saving ELSE length(text) END AS chars, trimmed, total < duration * (1 - 0.1::DOUBLE) AS short FROM taken""",
    ),
    "nar13_nearest": with_ctes(
        "written",
        """
SELECT t.project_id, t.page_index,
  last_value(nullif(narration, '') IGNORE NULLS) OVER (PARTITION BY t.project_id ORDER BY t.page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(nullif(narration, '') IGNORE NULLS) OVER (PARTITION BY t.project_id ORDER BY t.page_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
FROM typed t LEFT JOIN written w ON w.project_id = t.project_id AND w.page_index = t.page_index""",
    ),
    "nar14_batches": with_ctes(
        "written",
        """
SELECT project_id, batch, list(page_index ORDER BY page_index) AS page_indexes
FROM (
  SELECT t.project_id, t.page_index, ((row_number() OVER (PARTITION BY t.project_id ORDER BY t.page_index) - 1) // 4)::INT AS batch, coalesce(narration, '') <> '' AS done
  FROM typed t LEFT JOIN written w ON w.project_id = t.project_id AND w.page_index = t.page_index
) GROUP BY project_id, batch HAVING NOT bool_and(done)""",
    ),
    "nar15_rewrite": with_ctes(
        "scenes",
        """
SELECT project_id, scene_id, CASE WHEN source_page % 4 = 2 THEN 'New words here.' ELSE narration END AS narration,
  CASE WHEN source_page % 4 = 2 THEN round(3 / 2.6::DOUBLE, 3) ELSE duration END AS duration FROM scenes""",
    ),
    "nar16_keys": with_ctes(
        "scenes",
        """
SELECT DISTINCT project_id, CASE source_page % 3 WHEN 0 THEN scene_id WHEN 1 THEN source_page::VARCHAR ELSE 'nowhere' END AS key,
  CASE WHEN source_page % 3 < 2 THEN source_page END AS source_page FROM scenes""",
    ),
    "tim3_windows": with_ctes(
        "segments",
        """
SELECT project_id, page_index, seg_seq AS unit_seq, upto - d AS start, upto AS "end"
FROM (SELECT *, length(text) / 8.0::DOUBLE AS d, sum(length(text) / 8.0::DOUBLE + CASE WHEN seg_seq = 1 THEN 0 ELSE 0.75 END::DOUBLE) OVER (PARTITION BY project_id, page_index ORDER BY seg_seq) AS upto FROM segments)""",
    ),
    "tim4_allocate": with_ctes("timed", "SELECT * FROM timed"),
    "tim5_boundaries": with_ctes("weighed", "SELECT project_id, page_index, seg_seq, floor(total * upto::DOUBLE / whole::DOUBLE * 1000 + 0.5) / 1000 AS expected FROM weighed WHERE NOT last"),
    "tim7_ladder": with_ctes(
        "timed", "SELECT *, CASE WHEN page_index % 5 = 0 THEN 'provider' WHEN page_index % 3 = 0 THEN 'silence' ELSE 'estimate' END AS timing_source FROM timed"
    ),
    "tim8_shift": with_ctes("timed", 'SELECT project_id, page_index, seg_seq, floor((start + 1.1::DOUBLE) * 1000 + 0.5) / 1000 AS start, floor(("end" + 1.1::DOUBLE) * 1000 + 0.5) / 1000 AS "end" FROM timed'),
    "tim9_revoice": with_ctes(
        "scenes",
        """
SELECT project_id, scene_id, reason FROM (
  SELECT *, CASE WHEN source_page % 4 = 0 THEN 'new' WHEN source_page % 5 = 0 THEN 'missing' WHEN source_page % 3 = 0 AND narration <> 'old' THEN 'changed' END AS reason FROM scenes
) WHERE reason IS NOT NULL""",
    ),
    "tim9_runs": with_ctes(
        "scenes",
        """
SELECT project_id, scene_id, run::INT AS run, CASE WHEN run = 0 THEN 'new' WHEN source_page % 5 = 0 THEN 'missing' ELSE 'changed' END AS reason
FROM scenes CROSS JOIN range(4) t(run) WHERE run IN (0, 3) OR source_page % 5 = 0 OR (run = 1 AND source_page % 3 = 0)""",
    ),
    "tim10_unbroken": with_ctes("unbroken", "SELECT * FROM unbroken"),
    "tim11_total": with_ctes("scenes", "SELECT project_id, round(sum(duration), 3) AS duration FROM scenes GROUP BY project_id"),
}
