"""A stored index of a catalogue for searches by words: posting lists of runs of three characters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.operators.views import hay, matches

#: Characters of a gram, and folders that grams are dealt to by their hash.
SIZE, FOLDERS = 3, 16
#: Grams of a query whose lists are intersected; what they leave is verified anyway.
MOST_GRAMS = 8


def folder_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def grams(text: Column) -> Column:
    """The distinct runs of ``SIZE`` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{SIZE}}}))"), F.lit(1)))


@dataclass
class Index:
    """``postings`` (``gram, key, folder``) and ``counts`` (``gram, n, folder``) of a catalogue's ``fields``, in folders by gram."""

    postings: DataFrame
    counts: DataFrame
    fields: list[str]
    key: str


def build_index(catalog: DataFrame, fields: list[str], key: str, path: str) -> Index:
    """Write the index of a catalogue to ``path`` and return it. Keys are taken to be distinct and not null.

    A gram that a third of all entries have is dealt to several tasks by the key, and its count is summed up in parts.
    """
    rows = catalog.select(F.col(key).alias("key"), F.explode(grams(hay(fields))).alias("gram")).withColumn("folder", folder_of(F.col("gram")))
    postings, counts = f"{path}/postings", f"{path}/counts"
    spread = rows.repartition(FOLDERS, "folder", F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("folder", "gram")
    spread.write.mode("overwrite").partitionBy("folder").parquet(postings)
    read = catalog.sparkSession.read
    kept = read.schema(spread.schema).parquet(postings)
    kept.groupBy("folder", "gram").agg(F.count("*").alias("n")).write.mode("overwrite").partitionBy("folder").parquet(counts)
    return Index(kept, read.schema("gram string, n bigint, folder int").parquet(counts), fields, key)


def folders(spark, asked: list[str]) -> list[int]:
    return sorted({r.f for r in spark.createDataFrame([(g,) for g in asked], "g string").select(folder_of(F.col("g")).alias("f")).collect()})


def candidates(index: Index, query: str) -> DataFrame | None:
    """``key`` of the entries that hold all the query's rarest grams; None if no word is long enough, so all must be looked at.

    Only the folders of the query's grams are read: first their counts, then the lists of the ``MOST_GRAMS`` rarest.
    """
    asked = sorted({w[i : i + SIZE] for w in query.lower().split() for i in range(len(w) - SIZE + 1)})
    if not asked:
        return None
    spark = index.postings.sparkSession
    known = index.counts.filter(F.col("folder").isin(folders(spark, asked)) & F.col("gram").isin(asked)).collect()
    if len(known) < len(asked):  # a gram that no entry has
        return index.postings.filter(F.lit(False)).select("key")
    rare = [r.gram for r in sorted(known, key=lambda r: (r.n, r.gram))[:MOST_GRAMS]]
    lists = index.postings.filter(F.col("folder").isin(folders(spark, rare)) & F.col("gram").isin(rare))
    return lists.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare)).select("key")


def matching(index: Index, catalog: DataFrame, query: str) -> DataFrame:
    """The entries that every word of the query stands in, verified; the same as a scan with ``matches`` gives."""
    found = candidates(index, query)
    rows = catalog if found is None else catalog.join(found.withColumnRenamed("key", index.key), index.key, "left_semi")
    return rows.filter(matches(query, index.fields))


def indexed_search(index: Index, catalog: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """VW-7 by the index: the first entries that match, installed ones first, then by key, with ``matched`` and ``total``."""
    found = matching(index, catalog, query)
    counts = found.agg(F.count("*").alias("matched")).join(catalog.agg(F.count("*").alias("total")))
    return found.orderBy(F.desc("installed"), index.key).limit(limit).join(F.broadcast(counts))


def indexed_facets(index: Index, catalog: DataFrame, query: str, facet: str) -> DataFrame:
    """VW-9 by the index: matching entries by facet."""
    return matching(index, catalog, query).groupBy(facet).agg(F.count("*").alias("n"))
