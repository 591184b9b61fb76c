"""How filters interact: what each order of them removes, at which step, and how much of it another filter had removed.

Documents are first counted by the set of filters that they fail, a mask. For the masks and for all orders of the
filters one min-plus product gives the step at which a document goes: the least position, in the order's inverse
permutation, of a filter that it fails. All counts follow from that matrix and the masks' weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.llm.common import stored, table

#: Thresholds of the five filters: fewest words, least percent of distinct words, most percent of capitals.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 50, 65, 5
SYMBOLS = r"[#$%&*|]"
FILTERS = "ABCDE"
_SPACES, _SPACE_RUN = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"
#: Greater than any step: a document that fails no filter isn't removed.
NEVER = 1 << 20

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def positions(orders: np.ndarray) -> np.ndarray:
    """``[order, filter]``: the filter's step from 0, by inverting each permutation."""
    return np.argsort(orders, axis=1)


def removal_steps(fails: np.ndarray, where: np.ndarray) -> np.ndarray:
    """``[mask, order]``: the min-plus product of the masks (0 where a filter fails, else ``NEVER``) and the positions."""
    cost = np.where(fails, 0, NEVER)
    least = cost[:, :1] + where[None, :, 0]
    for f in range(1, fails.shape[1]):
        least = np.minimum(least, cost[:, f, None] + where[None, :, f])
    return np.minimum(least, NEVER)


def interactions(masks: np.ndarray, weights: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Counts for every order and step, as arrays ``[order, step]``.

    ``masks`` are bit sets (bit f: filter f fails), ``weights[mask]`` the numbers of documents, of good and of toxic ones.
    """
    orders = np.array(list(permutations(range(filters))))
    where = positions(orders)
    fails = (masks[:, None] >> np.arange(filters)) & 1 == 1
    steps = removal_steps(fails, where)
    count, shape = len(orders), (len(orders), filters)
    mask, order = np.nonzero(steps < NEVER)
    cell = order * filters + steps[mask, order]

    def scattered(cells: np.ndarray, amounts: np.ndarray) -> np.ndarray:
        out = np.zeros(count * filters, np.int64)
        np.add.at(out, cells, amounts)
        return out.reshape(shape)

    removed, good, toxic = (scattered(cell, weights[mask, k]) for k in range(3))
    late = fails[:, None, :] & (steps[:, :, None] < where[None])
    mask, order, one = np.nonzero(late)
    redundant = scattered(order * filters + where[order, one], weights[mask, 0])
    alone = np.array([weights[masks == 1 << f, 0].sum() for f in range(filters)])
    shapley = np.array([removed[np.arange(count), where[:, f]].sum() for f in range(filters)])
    return {
        "kept": weights[:, 0].sum() - np.cumsum(removed, axis=1),
        "removed": removed,
        "redundant": redundant,
        "unique_fails": alone[orders],
        "good_lost": good,
        "toxic_lost": toxic,
        "shapley": shapley[orders],
    }


def tallied(rows: DataFrame, part: str, mask: str, n: Column, good: Column, toxic: Column) -> DataFrame:
    """``part, masks``: for each part its masks with their weights, two to the number of filters at most."""
    part_, mask_ = F.col(part).alias("part"), F.col(mask).alias("mask")
    sums = rows.groupBy(part_, mask_).agg(F.sum(n).alias("n"), F.sum(F.when(good, n).otherwise(0)).alias("good"), F.sum(F.when(toxic, n).otherwise(0)).alias("toxic"))
    return sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))


def audited(tallies: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for every part, order of the filters (named by a letter each) and step from 1; zeros are included."""
    names = np.array(["".join(x) for x in permutations(filters)])
    orders, k = np.repeat(names, len(filters)), len(filters)
    steps = np.tile(np.arange(1, k + 1, dtype=np.int32), len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                found = np.array([[m["mask"], m["n"], m["good"], m["toxic"]] for m in masks], np.int64)
                counts = interactions(found[:, 0], found[:, 1:], k)
                columns = [pa.array([part] * len(orders), pa.string()), pa.array(orders), pa.array(steps)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(x.ravel().astype(np.int64)) for x in counts.values())],
                    names=["part", "filter_order", "step", *counts],
                )

    return tallies.mapInArrow(run, RESULT)


def checked(docs: DataFrame) -> DataFrame:
    """``doc_id, part, fails, digest``: bits of the filters A to D on the whole text, and its SHA-256 for E."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    trimmed = F.btrim("text", F.lit(_SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE_RUN))
    rows = rows.select("*", words.alias("words")).select("doc_id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("own"))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failures = (
        F.col("n") < LEAST_WORDS,
        100 * F.col("own").cast("long") < LEAST_DISTINCT_PERCENT * F.col("n").cast("long"),
        100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * F.length("text").cast("long"),
        F.col("text").rlike(SYMBOLS),
    )
    fails = sum((F.when(x, F.lit(1 << f)).otherwise(0) for f, x in enumerate(failures)), F.lit(0))
    return rows.select("doc_id", "part", fails.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters' interactions in every part, a document's source.

    Null texts are empty; null and empty sources are one part. E compares whole texts by SHA-256 across the table: the
    least id of each text passes, and so do rows with a null id, which are smaller or larger than none. Every row counts, repeated
    ones too; rows with one id and one text stand or fall together. A document labelled twice is good, or toxic, if
    any of its labels says so; labels that are null say nothing. No documents give no rows. Other columns aren't read.

    Copies of one text meet in a partial minimum only; joins are by ids, and rows that are alike are counted before them.
    """
    checks = stored(checked(docs), "audit-checks")
    with_ids = checks.filter("doc_id IS NOT NULL")
    firsts = with_ids.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    of = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    of = of.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    alike = with_ids.groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n"))
    joined = alike.join(firsts, ["doc_id", "digest"], "left").join(of, "doc_id", "left")
    repeats = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    known = joined.select("part", (F.col("fails") + repeats).alias("mask"), "n", "good", "toxic")
    unknown = checks.filter("doc_id IS NULL").select(
        "part", F.col("fails").alias("mask"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("good"), F.lit(False).alias("toxic")
    )
    return audited(tallied(known.unionByName(unknown), "part", "mask", F.col("n"), F.col("good"), F.col("toxic")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
lab AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
checks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {A: len(words) < 50, B: 100 * len(list_distinct(words)) < 65 * len(words),
     C: 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), D: regexp_matches(text, '[#$%&*|]'),
     E: coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS f
  FROM words LEFT JOIN lab USING (doc_id)),
docs AS (
  SELECT part, good, toxic, row_number() OVER () AS k,
    list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails
  FROM checks),
tallies AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM docs GROUP BY part, fails),
letters(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM letters a, letters b, letters d, letters e, letters g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
gone AS (
  SELECT part, fails, n, good, toxic, filter_order, list_min(list_transform(fails, lambda x: strpos(filter_order, x))) AS went
  FROM tallies CROSS JOIN orders),
steps AS (
  SELECT part, filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter,
    sum(n) FILTER (WHERE went IS NULL OR went > step) AS kept, sum(n) FILTER (WHERE went = step) AS removed,
    sum(n) FILTER (WHERE went < step AND list_contains(fails, substr(filter_order, step, 1))) AS redundant,
    sum(n) FILTER (WHERE fails = [substr(filter_order, step, 1)]) AS unique_fails,
    sum(good) FILTER (WHERE went = step) AS good_lost, sum(toxic) FILTER (WHERE went = step) AS toxic_lost
  FROM gone CROSS JOIN range(1, 6) t(step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM steps
"""
