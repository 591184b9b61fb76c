"""Near-duplicate documents by SimHash, compared exactly in tiles.

Cut into ``radius + m`` bit ranges, fingerprints within ``radius`` bits of each other agree in at least m of them, so
only fingerprints that share the values of some m ranges are compared: this deals the work out without losing a pair.
The larger the corpus, the larger m, so that few fingerprints are expected to share a key by chance and the number of
comparisons grows with the corpus and not with its square; the links are the same whatever m is.

What shares a key is compared exactly, tile against tile, with numpy exclusive-or and bit counts; tiles are cut in
order of the fingerprints' population counts, and tile pairs whose counts differ beyond the radius are skipped. A key
that very many fingerprints share is cut into tiles by population counts too, which are dealt to different tasks in
pairs, without the pairs that would be skipped. A spanning forest of the links found is passed on, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.llm.common import bytes_of, documents, fresh, shared_path, stored, table

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints in a tile of a key that is dealt to several tasks, in a tile that is compared at once, and in a group
#: that is compared with all other such groups of a batch at once.
DEALT_TILE, TILE, SMALL = 16_384, 128, 32
#: Fingerprints that may be expected to share a key by chance before more ranges have to agree.
EXPECTED = 64
#: Neighbours from which a node's join is a broadcast, so that no task gets all of them.
HUB = 100_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if over half the hashes of the lower-cased text's shingles have it. No words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n = max(1, len(words) - shingle + 1)
    last = end[shingle - 1 :] if len(words) >= shingle else end[-1:]
    spans = zip((end - size)[:n].tolist(), last.tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", n)
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        votes += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` for every row; ``fp`` is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x) for x in bytes_of(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


class _Forest:
    """Connected sets of 0..n-1; the label of each is its smallest member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            low = np.minimum(a, b)
            np.minimum.at(self.label, a, low)
            np.minimum.at(self.label, b, low)
            while (self.label != (up := self.label[self.label])).any():
                self.label = up
            apart = self.label[i] != self.label[j]
            i, j = i[apart], j[apart]


def tile_pairs(pop: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Where the tiles start that have to be compared, given ascending population counts.

    The other pairs of tiles are skipped: all their counts differ by more than the radius, and so do their bits.
    """
    for a in range(0, len(pop), TILE):
        last = pop[min(a + TILE, len(pop)) - 1]
        for b in range(a, len(pop), TILE):
            if pop[b] - last > radius:
                break
            yield a, b


def _compare_tiles(x: np.ndarray, pop: np.ndarray, side: np.ndarray, across: bool, radius: int, forest: _Forest, at: int) -> None:
    """Join in the forest what links in one group, whose fingerprints start at place ``at`` of it."""
    label = forest.label[at : at + len(x)]
    for a, b in tile_pairs(pop, radius):
        near = np.bitwise_count(x[a : a + TILE, None] ^ x[None, b : b + TILE]) <= radius
        near &= label[a : a + TILE, None] != label[None, b : b + TILE]
        if across:
            near &= side[a : a + TILE, None] != side[None, b : b + TILE]
        if near.any():
            i, j = np.nonzero(near)
            forest.join(at + a + i, at + b + j)


def group_links(fp: np.ndarray, side: np.ndarray, bounds: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group ``bounds[g] : bounds[g + 1]``, as two arrays of places in ``fp``.

    In a group with two sides only links across them are looked for.
    """
    size = np.diff(bounds)
    group = np.repeat(np.arange(len(size)), size)
    pop = np.bitwise_count(fp).astype(np.int16)
    order = np.lexsort((pop, group))
    x, p, s, forest = fp[order], pop[order], side[order], _Forest(len(fp))
    two = np.minimum.reduceat(side, bounds[:-1]) != np.maximum.reduceat(side, bounds[:-1])
    for d in range(1, SMALL):
        i = np.flatnonzero((group[:-d] == group[d:]) & (size[group[:-d]] <= SMALL))
        if not len(i):
            break
        i = i[p[i + d] - p[i] <= radius]
        near = (np.bitwise_count(x[i] ^ x[i + d]) <= radius) & (~two[group[i]] | (s[i] != s[i + d]))
        forest.join(i[near], i[near] + d)
    for g in np.flatnonzero(size > SMALL).tolist():
        lo, hi = int(bounds[g]), int(bounds[g + 1])
        _compare_tiles(x[lo:hi], p[lo:hi], s[lo:hi], bool(two[g]), radius, forest, lo)
    linked = np.flatnonzero(forest.label != np.arange(len(x)))
    return order[linked], order[forest.label[linked]]


def key_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks, one for each key: fingerprints within the radius are equal under at least one of them.

    There are ``radius + m`` ranges, and a mask for any m of them; m is the least for which n fingerprints with even
    bits share a key with no more than ``EXPECTED`` others.
    """
    m = 1
    while True:
        ranges = [range(64 * k // (radius + m), 64 * (k + 1) // (radius + m)) for k in range(radius + m)]
        bits = sum(sorted(map(len, ranges))[:m])
        if n <= EXPECTED << bits or radius + m >= 16:
            return [sum(1 << b for r in some for b in r) for some in combinations(ranges, m)]
        m += 1


def links(reps: DataFrame, radius: int = RADIUS, n: int | None = None) -> DataFrame:
    """``a, b``: links between rows ``rep, fp`` of different fingerprints; their connected sets are those of all links.

    The masks are chosen for ``n`` fingerprints (their number, if not given).
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in key_masks(reps.count() if n is None else n, radius)]
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(masks)])
    rows = reps.select("rep", "fp", F.explode(keys).alias("v")).select("rep", "fp", "v.band", "v.value")
    # of a key that is dealt out, a tile is a bin of population counts, radius + 1 of them wide, and a part of it
    bin_of = F.floor(F.bit_count("fp") / (radius + 1)).cast("int")
    crowded = rows.groupBy("band", "value").count().filter(F.col("count") > DEALT_TILE).select("band", "value")
    sizes = rows.join(crowded, ["band", "value"], "left_semi").groupBy("band", "value", bin_of.alias("bin")).count()
    bins = F.struct("bin", F.ceil(F.col("count") / DEALT_TILE).cast("int").alias("parts"))
    tiles = sizes.groupBy("band", "value").agg(F.collect_list(bins).alias("bins"))
    rows = rows.join(tiles, ["band", "value"], "left").withColumn("bin", bin_of)
    parts = F.filter("bins", lambda x: x["bin"] == F.col("bin"))[0]["parts"]
    own = F.coalesce(F.col("bin") * (1 << 20) + F.pmod(F.xxhash64("fp"), parts).cast("int"), F.lit(0))
    beside = F.filter("bins", lambda x: F.abs(x["bin"] - F.col("bin")) <= 1)
    others = F.flatten(F.transform(beside, lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda t: x["bin"] * (1 << 20) + t)))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0)))))
    group = ["band", "value", "low", "high"]
    dealt = rows.select("band", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "fp")
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rest = ["band", "value", "low", "high", "own", "rep", "fp"], None
        for batch in batches:
            got = [batch.column(n).to_numpy() for n in names]
            if rest is not None:
                got = [np.concatenate(x) for x in zip(rest, got, strict=True)]
            cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in got[:4]])) + 1
            if not len(cut):
                rest = got
                continue
            rest = [x[cut[-1] :] for x in got]
            yield _links_of([x[: cut[-1]] for x in got], np.concatenate([[0], cut]), radius)
        if rest is not None and len(rest[0]):
            yield _links_of(rest, np.array([0, len(rest[0])]), radius)

    return dealt.mapInArrow(compare, "a long, b long")


def _links_of(columns: list[np.ndarray], bounds: np.ndarray, radius: int) -> pa.RecordBatch:
    own, rep, fp = columns[4], columns[5], columns[6].view(np.uint64)
    i, j = group_links(fp, own, bounds, radius)
    return pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])


def _with_least(both: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """Each row ``a, b`` with the column ``m`` of its ``a``.

    Nodes with very many neighbours are joined by a broadcast: there are at most a ``HUB``-th as many as rows, and none
    if there are no more than ``HUB`` edges.
    """
    if edges <= HUB:
        return both.join(least.select("a", "m"), "a")
    hubs = F.broadcast(least.filter(F.col("degree") > HUB).select("a", "m"))
    others = both.join(hubs.select("a"), "a", "left_anti").join(least.select("a", "m"), "a")
    return both.join(hubs, "a").unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of an edge ``a, b``.

    Alternates two steps that hang the neighbours of a node on the smallest of them (large star, small star) until
    nothing changes. Every step is a grouping with partial minima and a join; each round is written and read back, in
    two folders that take turns.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    paths = [shared_path(edges.sparkSession, "links") for _ in range(2)]
    edges, before, turn = stored(edges, "links", paths[0]), None, 0
    n = edges.count()
    while True:
        turn = 1 - turn
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("degree"))
        large = _with_least(both, least, n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        small = _with_least(large, least, n).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), "links", paths[turn])
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, n = now, now[0]


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row; the component's id is the smallest document id reachable.

    A null text has no words and fingerprint 0. A row with a null id links nothing; it gets the component of its
    fingerprint, if other rows have it, else null. Rows with equal ids each give a row. Other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).dropna(), "representatives")
    roots = components(links(reps, radius))
    found = reps.join(roots, F.col("rep") == F.col("node"), "left")
    found = found.select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(found, "fp", "left").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that come first in their component: one document of each group stays.

    Rows with a null id stay; of rows with equal ids, one with the smallest text hash stays. Columns may have any name.
    """
    found = stored(near_duplicates(docs, radius, id_col, text_col).filter("doc_id is not null"), "components")
    gone_id, key, least_key, least_hash = fresh(docs, "__gone", "__h", "__k", "__least")
    gone = found.filter("doc_id != component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    kept = docs.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")
    if (found.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0) > 1:
        named = kept.filter(F.col(id_col).isNotNull()).withColumn(key, F.xxhash64(F.coalesce(text_col, F.lit(""))))
        least = named.groupBy(F.col(id_col).alias(least_key)).agg(F.min(key).alias(least_hash))
        named = named.join(least, (F.col(id_col) == F.col(least_key)) & (F.col(key) == F.col(least_hash)))
        named = named.drop(key, least_key, least_hash).dropDuplicates([id_col])
        kept = named.unionByName(kept.filter(F.col(id_col).isNull()))
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
