"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

A source's target share of the mix, over its share of the corpus, is the mean number of times that its documents
repeat. Each document draws its number of copies from the Poisson distribution with that mean, by inverting the
distribution function at a number in [0, 1) that a seeded hash of its id gives. Copies are then shuffled globally: each
goes to a partition, and to a place in it, by a hash of its id and number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.llm.common import fresh, stored, table

SEED = "mix-1"
#: Distribution functions with more entries than this in all are joined, not broadcast (8 bytes an entry).
BROADCAST_ENTRIES = 1_000_000
#: Parts that the rows of a source are dealt to where its rates are not broadcast.
SALTS = 32


def hashed(*parts: Column | str, digits: int) -> Column:
    """A whole number of ``4 * digits`` bits from the MD5 of the parts, joined by colons; null parts are empty."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def size_tempered(docs: DataFrame, exponent: float = 0.5, source_col: str = "source") -> DataFrame:
    """``source, weight``: a source weighs its number of documents to a power, so small sources gain on large ones."""
    counts = docs.groupBy(F.col(source_col).alias("source")).count()
    return counts.select("source", F.pow(F.col("count").cast("double"), F.lit(exponent)).alias("weight"))


def repetition(docs: DataFrame, weights: DataFrame, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """``source, mean, cdf`` for each source of the documents that has a weight over 0.

    ``mean`` is the target repetition rate: with weights normalised over the sources at hand, the mix has ``epochs``
    times as many documents as the corpus, on average. ``cdf[k]`` is the chance of k copies or fewer; it goes on until
    what is left is below the resolution of the draws. A null source is a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    named = weights.filter("weight > 0").select(F.col("source").alias("name"), "weight")
    both = stored(counts.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name"), "sources")
    weight = both.agg(F.sum("weight")).first()[0] or 1.0
    rows = counts.agg(F.sum("n")).first()[0] or 0
    means = both.select("source", (F.col("weight") / F.lit(weight) * F.lit(epochs * rows) / F.col("n")).alias("mean"))
    most = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 40).cast("int")
    terms = means.withColumn("k", F.explode(F.sequence(F.lit(0), most)))
    by_k = Window.partitionBy("source").orderBy("k")
    log_factorial = F.sum(F.when(F.col("k") > 0, F.ln(F.col("k").cast("double"))).otherwise(0.0)).over(by_k)
    terms = terms.withColumn("p", F.exp(F.col("k") * F.ln("mean") - F.col("mean") - log_factorial))
    terms = terms.withColumn("c", F.sum("p").over(by_k))
    pairs = F.array_sort(F.collect_list(F.struct("k", "c")))
    return terms.groupBy("source", "mean").agg(F.transform(pairs, lambda x: x["c"]).alias("cdf"))


def mix(
    docs: DataFrame,
    weights: DataFrame,
    epochs: float = 1.0,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    copy_col: str = "copy",
    key_col: str = "shuffle_key",
) -> DataFrame:
    """The copies, with all columns of the documents, the copy's number from 1 and its place in the global shuffle.

    A document of a source without a weight has no copy. Rows with equal ids draw alike; a null id draws as the empty
    text. Rows with a null source go by the weight of the null source, if there is one. An empty table gives no rows.
    The key is 60 bits; in each partition rows are in its order, and partitions take rows by its hash. Columns of the
    documents may have any name but ``copy_col`` and ``key_col``, which are an error.
    """
    if clash := {c.lower() for c in docs.columns} & {copy_col.lower(), key_col.lower()}:
        raise ValueError(f"documents already have columns {sorted(clash)}; choose other names for copies and keys")
    table_of = stored(repetition(docs, weights, epochs, source_col), "repetition")
    entries = table_of.agg(F.sum(F.size("cdf"))).first()[0] or 0
    source, cdf, draw, times, salt, own = fresh(docs, "__source", "__cdf", "__u", "__n", "__salt", "__own_salt")
    rates = table_of.select(F.col("source").alias(source), F.col("cdf").alias(cdf))
    salts = 1
    if entries <= BROADCAST_ENTRIES:
        rates = F.broadcast(rates)
    else:  # one source may have a third of all rows, so its rows are dealt to several tasks
        salts = SALTS
        rates = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    doc_id = F.col(id_col).cast("string")
    u = hashed(F.lit(seed), doc_id, digits=13) / F.lit(float(1 << 52))
    # drawn before the join: the optimizer would copy the hash into the comparison with each entry otherwise
    rows, alike = docs.withColumn(draw, u), F.col(source_col).eqNullSafe(F.col(source))
    if salts > 1:
        rows = rows.withColumn(own, F.pmod(F.xxhash64(F.col(id_col), F.spark_partition_id()), F.lit(salts)).cast("int"))
        alike &= F.col(own) == F.col(salt)
    rows = rows.join(rates, alike)
    rows = rows.withColumn(times, F.size(F.filter(cdf, lambda c: c <= F.col(draw)))).drop(source, cdf, draw, salt, own)
    copies = rows.filter(F.col(times) > 0).withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times)
    copies = copies.withColumn(key_col, hashed(F.lit(seed), doc_id, F.col(copy_col).cast("string"), digits=15))
    return copies.repartition(F.col(key_col)).sortWithinPartitions(key_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, size_tempered(docs))


#: The same in DuckDB. A draw is compared with sums of doubles, which both engines add up in the same order.
SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
means AS (
  SELECT source, sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n AS mean
  FROM counts
),
terms AS (SELECT source, mean, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 40)::BIGINT + 1)) AS k FROM means),
logs AS (
  SELECT source, mean, k, sum(CASE WHEN k > 0 THEN ln(k::DOUBLE) ELSE 0.0 END) OVER (PARTITION BY source ORDER BY k) AS lf
  FROM terms
),
cdf AS (
  SELECT source, k, sum(exp(k * ln(mean) - mean - lf)) OVER (PARTITION BY source ORDER BY k) AS c FROM logs
),
draws AS (
  SELECT doc_id, text, source,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents
),
counted AS (
  SELECT d.doc_id, d.text, d.source, count(c.k) AS n
  FROM draws d LEFT JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u
  GROUP BY d.doc_id, d.text, d.source, d.u
),
copies AS (SELECT doc_id, text, source, unnest(range(1, n + 1))::INTEGER AS "copy" FROM counted)
SELECT doc_id, text, source, "copy",
  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || "copy"::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM copies
"""
