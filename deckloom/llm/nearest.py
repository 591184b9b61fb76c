"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by learned rotations. Rows are dealt to shards of bounded size; each shard indexes every
byte of its codes. A query probes each byte's buckets at growing distance: once all bytes have been probed to
distance t, every code within ``bytes * (t + 1) - 1`` bits has been met (else each byte would differ in over t bits).
It stops when enough codes lie within that radius, and ranks these by distances of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.llm.common import table

#: Rows that the rotations are fitted on at most, and bits of a code.
SAMPLE_ROWS, BITS = 8192, 256
#: Rows of a shard, and codes of a shard whose vectors a query ranks at least.
SHARD_ROWS, RERANK = 8192, 400
_BITS_OF = np.bitwise_count(np.arange(256, dtype=np.uint8))


@dataclass
class Rotation:
    """``vector @ matrix > bias`` gives the bits of its code."""

    matrix: np.ndarray
    bias: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.matrix > self.bias, axis=1)


def fit_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 15) -> Rotation:
    """Rotations of the principal axes, each turned to bring vectors near the corners of a cube; more than one if a
    code has more bits than there are axes."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred + 1e-12 * np.eye(x.shape[1]))
    axes = axes[:, ::-1][:, :bits]
    v, parts = centred @ axes, []
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(np.random.default_rng(len(parts)).normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (u @ wt).T
        parts.append(axes @ turn)
    matrix = np.concatenate(parts, 1)[:, :bits]
    return Rotation(matrix, mean @ matrix)


class Index:
    """Buckets of each byte of the codes of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: Rotation):
        self.ids, self.vectors = ids, vectors
        codes = rotation.codes(vectors)
        self.bytes = codes.shape[1]
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        slot = codes.astype(np.int64) + 256 * np.arange(self.bytes)
        self.rows = np.argsort(slot.ravel(), kind="stable") // self.bytes
        self.size = np.bincount(slot.ravel(), minlength=256 * self.bytes)
        self.start = np.cumsum(self.size) - self.size

    def within(self, code: np.ndarray, enough: int) -> np.ndarray:
        """Rows of the nearest codes: all within the least radius that holds ``enough`` of them (or all rows)."""
        met, distance = np.zeros(len(self.ids), bool), np.full(len(self.ids), 1 << 20)
        apart = _BITS_OF[np.arange(256, dtype=np.uint8)[None, :] ^ code[:, None]].ravel()
        for t in range(9):
            bucket = np.flatnonzero((apart == t) & (self.size > 0))
            size = self.size[bucket]
            place = np.repeat(self.start[bucket] - np.cumsum(size) + size, size) + np.arange(size.sum())
            new = np.zeros(len(met), bool)
            new[self.rows[place]] = True
            new &= ~met
            met |= new
            got = np.flatnonzero(new)
            distance[got] = np.bitwise_count(self.words[got] ^ code.view(np.uint64)).sum(1)
            radius = self.bytes * (t + 1) - 1
            if (distance <= radius).sum() >= enough:
                break
        inside = np.flatnonzero(distance <= radius)
        if len(inside) > enough:
            inside = inside[distance[inside] <= np.partition(distance[inside], enough - 1)[enough - 1]]
        return inside

    def search(self, query: int, vector: np.ndarray, code: np.ndarray, k: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.within(code, enough)
        rows = rows[self.ids[rows] != query]
        away = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(1))
        best = np.lexsort((self.ids[rows], away))[:k]
        return self.ids[rows[best]], away[best]


def usable(vector: Column, length: int) -> Column:
    """Vectors of that length whose numbers are all finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == length) & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    sample_rows: int = SAMPLE_ROWS,
    shard_rows: int = SHARD_ROWS,
    rerank: int = RERANK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the k nearest other rows found, by Euclidean distance.

    Ties go to the smaller id. Null vectors and ids, zero vectors, and vectors with a null or non-finite number or of
    another length than most take no part. Rows with the same id count as one row if their vectors are equal; of unlike
    vectors of one id all are candidates, and the least is the query. A query's own id is never a candidate. An empty table gives no rows. Every row is indexed; queries meet every shard,
    so what moves is the table once and the queries once for each shard. A task holds one shard and a batch of queries.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows)
    sizes = sample.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = sizes.n if sizes else 1
    rows = rows.filter(usable(F.col("v"), length))
    fitted = sample.filter(usable(F.col("v"), length)).select("v").toArrow().column("v").combine_chunks()
    rotation = fit_rotation(np.asarray(fitted.flatten(), np.float64).reshape(-1, length))
    sent = spark.sparkContext.broadcast(rotation)
    shards = max(1, -(-rows.count() // shard_rows))
    data = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = rows.filter(F.coalesce("q", F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")
    dealt = data.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, held = -1, None, []
        for batch in batches:
            shard, kind, ids = (batch.column(c).to_numpy() for c in ("shard", "kind", "vec_id"))
            v = np.asarray(batch.column("v").flatten(), np.float64).reshape(-1, length)
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if hi == lo:
                    continue
                if shard[lo] != at:
                    at, index, held = shard[lo], None, []
                if kind[lo] == 0:
                    held.append((ids[lo:hi], v[lo:hi]))
                    continue
                if index is None:
                    if not held:
                        continue
                    own, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    same = np.zeros(len(own), bool)  # equal rows lie side by side
                    same[1:] = (own[1:] == own[:-1]) & (x[1:] == x[:-1]).all(1)
                    index, held = Index(own[~same], x[~same], sent.value), []
                out = [(q, *index.search(q, y, c, k, rerank)) for q, y, c in zip(ids[lo:hi].tolist(), v[lo:hi], sent.value.codes(v[lo:hi]), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64)),
                        pa.array(np.concatenate([o[1] for o in out])),
                        pa.array(np.concatenate([o[2] for o in out])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
