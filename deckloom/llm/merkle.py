"""A Merkle manifest of a table: leaves by row, a tree of each source, a tree over the sources, and proofs by descent.

Nodes are content-addressed: the store of a tree holds a digest and the digests of its children, one table for each
height. Requests for leaves go down from the root in step: a node of the frontier stands for all requested leaves
under it, its children are looked up by its digest, and the next digit of the leaves' ranks (to base 16) selects among
them. What isn't selected is a segment of the path; reversed, the segments lead from a leaf to the root.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.llm.common import stored, table

#: Children of a node at most.
FANOUT = 16
_SHIFT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_STEPS = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts put together, as lower-case hex digits."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of the value's UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def place_key(source: Column) -> Column:
    """A key that is never null and sorts as sources do: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(""))


@dataclass
class Tree:
    """``places`` has the columns ``place, rank, left, digest`` and others: a leaf's group, its rank there, and the group's size.

    ``levels[h]`` has ``place, rank, left, digest, children`` of the nodes at height h + 1; ``tops`` has the columns
    ``place, height, digest`` of each group's topmost node.
    """

    places: DataFrame
    levels: list[DataFrame]
    tops: DataFrame


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with a ``rank`` from 0 in their ``place`` by the columns of ``order``, and ``left``, the rows of the place.

    Rows are dealt to tasks by ranges, so a large place is spread over many of them. Their positions are written down
    before they are used, and a rank is the number of the place's rows in earlier ranges and before it in its own.
    Rows that tie in all columns of ``order`` may stand in any order.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "place", *order).sortWithinPartitions("place", *order)
    at = stored(dealt.withColumn("at", F.monotonically_increasing_id()), f"{name}-dealt").withColumn("part", F.shiftright("at", 33))
    starts = at.groupBy("place", "part").agg(F.min("at").alias("first"), F.count("*").alias("own"))
    place = Window.partitionBy("place")
    starts = starts.withColumn("left", F.sum("own").over(place)).withColumn(
        "before", F.coalesce(F.sum("own").over(place.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    return at.join(starts.drop("own"), ["place", "part"]).withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def grown(places: DataFrame, name: str) -> Tree:
    """The tree over each place's leaves: every 16 consecutive nodes become one, until one is left."""
    most = places.agg(F.max("left").alias("most")).first().most or 0
    tops = [places.filter("left = 1").select("place", F.lit(0).alias("height"), "digest")]
    levels, below = [], places
    while most > 1:
        run = below.filter("left > 1").groupBy("place", F.shiftright("rank", _SHIFT).alias("rank"), F.expr(f"(left + {FANOUT - 1}) div {FANOUT}").alias("left"))
        run = run.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x.digest).alias("children"))
        below = stored(run.withColumn("digest", digest(F.array_join("children", ""))), f"{name}-nodes")
        levels.append(below)
        tops.append(below.filter("left = 1").select("place", F.lit(len(levels)).alias("height"), "digest"))
        most = -(-most // FANOUT)
    first, *others = tops
    for x in others:
        first = first.unionByName(x)
    return Tree(places, levels, first)


def step(children: Column, position: Column) -> Column:
    """What of a run isn't selected: the digests before the position and those behind it."""
    own = position.cast("int")
    return F.struct(
        F.array_join(F.slice(children, 1, own), "").alias("before"),
        F.array_join(F.slice(children, own + 2, F.lit(FANOUT)), "").alias("after"),
    )


def descend(tree: Tree, roots: DataFrame, wanted: DataFrame, lowest: int) -> DataFrame:
    """The nodes at height ``lowest`` above ``wanted``, each with its ``path`` from the root on.

    ``roots`` has ``place, height, digest, path`` and columns that are handed down; ``wanted`` has the ``place, rank`` of
    leaves. A node below which no leaf is wanted isn't entered. Roots lower than ``lowest`` are returned as they are.
    """
    own = [c for c in roots.columns if c not in ("place", "height", "digest", "path")]
    prefixes, up = [], wanted.select("place", "rank").distinct()
    for _ in tree.levels:
        up = up.select("place", F.shiftright("rank", _SHIFT).alias("rank")).distinct()
        prefixes.append(up)
    start = roots.withColumn("rank", F.lit(0).cast("long"))
    columns = ["place", "rank", "digest", "path", *own]
    low = start.filter(F.col("height") <= lowest).select(*columns)
    frontier = None
    for height in range(len(tree.levels), lowest, -1):
        begun = start.filter(F.col("height") == height).select(*columns)
        frontier = begun if frontier is None else frontier.unionByName(begun)
        store = tree.levels[height - 1].select("digest", "children").dropDuplicates(["digest"])
        opened = frontier.join(store, "digest").select("place", "rank", "path", "children", *own, F.posexplode("children").alias("digit", "child"))
        opened = opened.select(
            "place",
            (F.shiftleft("rank", _SHIFT) + F.col("digit")).alias("rank"),
            F.col("child").alias("digest"),
            F.concat("path", F.array(step(F.col("children"), F.col("digit")))).alias("path"),
            *own,
        )
        asked = prefixes[height - 2] if height > 1 else wanted.select("place", "rank").distinct()
        frontier = opened.join(asked, ["place", "rank"], "left_semi")
    return low if frontier is None else low.unionByName(frontier)


@dataclass
class Manifest:
    """The root digest (null for no rows), a tree over the sources' subroots and a tree of the sources' leaves."""

    root: str | None
    top: Tree
    sources: Tree


def manifest(leaves: DataFrame) -> Manifest:
    """A manifest of ``leaves(doc_id, source, leaf, ...)``.

    A null source is a source of its own and the first; of one source's leaves those with a null id come first, and leaves
    with one id stand by their digests. Rows that are equal in all fields have equal leaves, and records of equal runs are kept once.
    """
    rows = leaves.withColumn("place", place_key(F.col("source"))).withColumnRenamed("leaf", "digest").drop("source")
    sources = grown(stored(ranked(rows, ["doc_id", "digest"], "merkle-leaves"), "merkle-places"), "merkle-source")
    subroots = sources.tops.select(F.lit("").alias("place"), F.col("place").alias("source"), "height", "digest")
    top = grown(stored(ranked(subroots, ["source"], "merkle-subroots"), "merkle-top-places"), "merkle-top")
    root = top.tops.first()
    return Manifest(root.digest if root else None, top, sources)


def proofs(found: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (rows of ``found.sources.places``) with ``subroot`` and ``path``: the steps from each leaf up to the root.

    Each step has the digests that stand ``before`` and ``after`` in the run. Descents meet no large group: a key is a
    node's digest, or a run of 16 leaves at most.
    """
    spark = requests.sparkSession
    none = F.array().cast(_NO_STEPS)
    places = found.top.places
    above = requests.select("place").distinct().withColumnRenamed("place", "source")
    asked = places.join(above, "source", "left_semi").select("place", "rank", "source", "height", F.col("digest").alias("subroot"))
    roots = found.top.tops.withColumn("path", none)
    reached = descend(found.top, roots, asked, 0).select("place", "rank", "path")
    starts = asked.join(reached, ["place", "rank"]).select(F.col("source").alias("place"), "height", F.col("subroot").alias("digest"), "subroot", "path")
    starts = stored(starts, "merkle-starts")
    runs = descend(found.sources, starts, requests, 1)
    store = found.sources.levels[0].select("digest", "children").dropDuplicates(["digest"]) if found.sources.levels else None
    if store is None:  # every source is a lone leaf
        runs = runs.withColumn("children", F.lit(None).cast("array<string>"))
    else:
        runs = runs.join(store, "digest", "left")
    runs = runs.select("place", F.col("rank").alias("run"), "subroot", "children", "path")
    own = F.col("rank").bitwiseAND(FANOUT - 1)
    last = F.when(F.col("children").isNull(), none).otherwise(F.array(step(F.col("children"), own)))
    met = requests.withColumn("run", F.shiftright("rank", _SHIFT)).join(runs, ["place", "run"])
    return met.withColumn("path", F.reverse(F.concat("path", last))).drop("run", "children")


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root digest that a leaf and the steps from it lead to."""
    return F.aggregate(path, leaf_digest, lambda own, s: digest(s.before, own, s.after))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings along the path, left to right and upwards."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.before, s.after)), ""), 256)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def document_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, tampered``: the leaf of each row's five fields, and where 5 divides the CRC-32 of its id
    (never for a null id) the leaf that it would have with its text in lower case, else null.

    Other columns aren't read; texts are read once and only digests go on.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c) for c in FIELDS[1:]))
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = leaf(*(F.col(c) for c in FIELDS[:-1]), lowered(F.col("text")))
    return rows.select("doc_id", "source", leaf(*map(F.col, FIELDS)).alias("leaf"), F.when(picked, changed).alias("tampered"))


def audit(docs: DataFrame) -> DataFrame:
    """Every row's leaf, subroot, root, proof and whether the row, tampered or not, still leads to the root.

    Null fields are told from empty ones. Repeated rows each give a row; an empty table gives none.
    """
    found = manifest(stored(document_leaves(docs), "merkle-documents"))
    met = proofs(found, found.sources.places)
    root = F.lit(found.root).cast("string")
    out = met.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        root.alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == root)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def _sql_leaf(text: str) -> str:
    values = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


_SQL_CRC = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), "
    "lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
)


def _sql_tree(name: str, leaves: str) -> str:
    return f"""
{name}(place, height, rank, size, digest, children) AS (
  {leaves}
  UNION ALL
  SELECT place, height + 1, rank // 16, any_value((size + 15) // 16), sha256(string_agg(digest, '' ORDER BY rank)), list(digest ORDER BY rank)
  FROM {name} WHERE size > 1 GROUP BY place, height, rank // 16)"""


def _sql_climb(name: str, starts: str, tree: str) -> str:
    return f"""
{name}(doc, place, height, rank, folded, siblings) AS (
  {starts}
  UNION ALL
  SELECT c.doc, c.place, n.height, n.rank, sha256(array_to_string(n.children[:c.rank % 16], '') || c.folded || array_to_string(n.children[c.rank % 16 + 2:], '')),
    c.siblings || array_to_string(n.children[:c.rank % 16], '') || array_to_string(n.children[c.rank % 16 + 2:], '')
  FROM {name} c JOIN {tree} n ON n.place = c.place AND n.height = c.height + 1 AND n.rank = c.rank // 16)"""


#: For rows without repeated ids in one source.
SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('+' || source, '') AS place, {_sql_leaf("text")} AS leaf,
    CASE WHEN {_SQL_CRC} % 5 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY place) AS size,
    row_number() OVER (ORDER BY place, doc_id NULLS FIRST, leaf) AS doc
  FROM leaves),
{_sql_tree("nodes", "SELECT place, 0, rank, size, leaf, NULL::VARCHAR[] FROM placed")},
subroots AS (
  SELECT place AS source_place, digest, row_number() OVER (ORDER BY place) - 1 AS rank, count(*) OVER () AS size FROM nodes WHERE size = 1),
{_sql_tree("top_nodes", "SELECT '', 0, rank, size, digest, NULL::VARCHAR[] FROM subroots")},
{_sql_climb("climb", "SELECT doc, place, 0, rank, coalesce(tampered, leaf), '' FROM placed", "nodes")},
reached AS (SELECT doc, place, folded, siblings FROM climb QUALIFY row_number() OVER (PARTITION BY doc ORDER BY height DESC) = 1),
{_sql_climb("top_climb", "SELECT r.doc, '', 0, s.rank, r.folded, r.siblings FROM reached r JOIN subroots s ON s.source_place = r.place", "top_nodes")},
ends AS (SELECT doc, folded, siblings FROM top_climb QUALIFY row_number() OVER (PARTITION BY doc ORDER BY height DESC) = 1),
root AS (SELECT digest FROM top_nodes WHERE size = 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, root.digest AS root, sha256(e.siblings) AS proof_sha256, e.folded AS folded_root, e.folded = root.digest AS verified
FROM placed p JOIN subroots s ON s.source_place = p.place JOIN ends e USING (doc) CROSS JOIN root
"""
