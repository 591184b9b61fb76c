"""Searches by posting lists give what a scan gives, and read the folders of the query's grams alone."""

import random
import re

from deckloom.operators import catalog_index, views
from pyspark.sql import functions as F


def test_searches_by_postings_are_those_of_a_scan(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéß ", k=rng.randrange(1, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=4)) if i % 9 else None, rng.choice(["EN", "de", ""]), i % 5 == 0) for i in range(400)]
    catalog = spark.createDataFrame(rows, "id int, title string, lang string, installed boolean")
    fields = ["title", "lang"]
    index = catalog_index.build_index(catalog, fields, "id", str(tmp_path / "index"))
    queries = ["", "en", "a", "zzz", "a zzz", *[w for w in words if w.strip()][:6], *[f"{a[:4]} {b}" for a, b in zip(words, words[7:])][:4], "ABC", "déß"]
    hits = 0
    for query in queries:
        want = [tuple(r) for r in catalog.filter(views.matches(query, fields)).orderBy("id").collect()]
        assert [tuple(r) for r in catalog_index.matching(index, catalog, query).orderBy("id").collect()] == want, query
        hits += bool(want)
    assert hits > 4
    for query in ("en", words[3]):
        by = lambda df: sorted(map(tuple, df.select("id", "matched", "total").collect()))
        assert by(catalog_index.indexed_search(index, catalog, query, 7)) == by(views.catalog_search(catalog, query, fields, "id", 7))
        assert sorted(map(tuple, catalog_index.indexed_facets(index, catalog, query, "lang").collect())) == sorted(map(tuple, views.faceted_search(catalog, query, fields, "lang").collect()))


def test_only_the_folders_of_the_querys_grams_are_read(spark, tmp_path):
    catalog = spark.range(2000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("title"))
    index = catalog_index.build_index(catalog, ["title"], "id", str(tmp_path / "index"))
    found = catalog_index.candidates(index, "0a1b2")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    asked = catalog_index.folders(spark, ["0a1", "a1b", "1b2"])
    assert len(asked) <= 3 and re.search(r"PartitionFilters: \[[^\]]*folder#\d+ (IN|=)", plan) and re.search(r"PushedFilters: \[[^\]]*In\(gram", plan)
    assert catalog_index.candidates(index, "a b cd") is None
    assert catalog_index.matching(index, catalog.limit(0), "0a1b2").count() == 0


def test_an_empty_catalogue(spark, tmp_path):
    none = spark.createDataFrame([], "id int, title string, installed boolean")
    index = catalog_index.build_index(none, ["title"], "id", str(tmp_path / "index"))
    assert catalog_index.indexed_search(index, none, "abc").count() == 0 and catalog_index.matching(index, none, "a").count() == 0
