"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.llm.common import bytes_of, documents, shared_path, table
from deckloom.llm.tokens import word_encoder

STORED = "doc_id long, part int, part_start long, n_tokens int, token_ids array<int>"
#: Ids that one Arrow batch of encoded documents holds, about.
BATCH_IDS = 1 << 18
#: Files whose ids are summed up in one group, and files up to which their offsets (16 bytes each) are broadcast.
FILE_BLOCK, BROADCAST_FILES = 1024, 1 << 20


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    stripe_bytes: int = 16 << 20,
    index_stride: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every text and write the ids to ORC files under ``path``/ids in ascending order of document ids.

    Texts are dealt by ranges of ids and sorted before they are encoded, so each text is encoded once and file k holds
    smaller ids than file k+1. ORC stores the ids as run-length encoded integers; row indexes and a Bloom filter on
    ``doc_id`` let a reader skip stripes and row groups, and stripes can be read in parallel.

    ``part`` is the file's number and ``part_start`` the ids before the document in its own file. A small table under
    ``path``/offsets holds the ids before each file, so readers need no scan to find where a document starts.

    A null text is empty: just ``end_id``. Null ids come first; rows with equal ids are ordered by their text's hash.
    An empty table gives files without rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, start = word_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, held, held_ids = [], [], 0
            for doc, x in zip(batch.column("doc_id").to_pylist(), words.encode(bytes_of(batch, "text")), strict=True):
                x = np.append(x, np.uint32(end_id))
                ids.append(x)
                held.append((doc, start, len(x)))
                start += len(x)
                held_ids += len(x)
                if held_ids > BATCH_IDS:
                    yield _stored_batch(held, ids, part)
                    ids, held, held_ids = [], [], 0
            if held:
                yield _stored_batch(held, ids, part)

    (
        ordered.mapInArrow(encode, STORED)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(f"{path}/ids")
    )
    written = spark.read.schema(STORED).orc(f"{path}/ids")
    in_file = written.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("ids"))
    in_file = in_file.withColumn("block", F.floor(F.col("part") / FILE_BLOCK))
    files, blocks = Window.partitionBy("block").orderBy("part"), Window.orderBy("block")
    ids_before = [F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for w in (files, blocks)]
    of_block = in_file.groupBy("block").agg(F.sum("ids").alias("ids")).select("block", ids_before[1].alias("block_before"))
    offsets = in_file.withColumn("before", ids_before[0]).join(of_block, "block")
    offsets.select("part", (F.col("before") + F.col("block_before")).alias("before")).coalesce(1).write.parquet(f"{path}/offsets")


def _stored_batch(held: list[tuple], ids: list[np.ndarray], part: int) -> pa.RecordBatch:
    n = np.array([x[2] for x in held], np.int32)
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in held], pa.int64()),
            pa.array(np.full(len(held), part, np.int32)),
            pa.array([x[1] for x in held], pa.int64()),
            pa.array(n),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))),
        ],
        names=["doc_id", "part", "part_start", "n_tokens", "token_ids"],
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, token_ids`` of all documents; ``start`` counts the ids of all documents before.

    A filter on ``doc_id`` prunes stripes and row groups by their statistics and Bloom filters; besides what is left,
    only the small table of offsets is read. It is broadcast up to 16 MB (a million files), and joined beyond that.
    """
    rows = spark.read.schema(STORED).orc(f"{path}/ids")
    offsets = spark.read.schema("part int, before long").parquet(f"{path}/offsets")
    if offsets.count() <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    start = (F.col("before") + F.col("part_start")).alias("start")
    return rows.join(offsets, "part").select("doc_id", start, F.col("n_tokens").cast("long").alias("n_tokens"), "token_ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """Replace ``token_ids`` by ``ids_crc32``, the unsigned CRC-32 of the ids as little-endian 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("token_ids")
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            kept = [batch.column(x) for x in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return rows.select("doc_id", "start", "n_tokens", "token_ids").mapInArrow(
        digest, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return with_crc32(read_token_files(spark, path))
