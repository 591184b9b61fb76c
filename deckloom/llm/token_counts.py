"""Token counts by a map-side two-tier lookup.

The first tier is a broadcast hash table with the token counts of frequent chunks (white space and the word after it),
of a fixed size; the second is a bounded cache in each Python worker, filled by the tokenizers library. Counting is one
narrow pass over all texts, without a shuffle.

The table is learned from a bounded part of the texts: the first ``TABLE_BYTES`` of ``TABLE_PARTS`` partitions, each
counted in its own task and passed on as one row. It only saves time: what it misses is counted all the same, and
exactly, through the worker caches.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from deckloom.llm.common import bytes_of, documents, pieces, table
from deckloom.llm.tokens import CHUNK, ChunkLengths, chunk_lengths

#: Entries of the broadcast table; it holds a few MB whatever the corpus.
TABLE_ENTRIES = 1 << 15
#: Partitions that the table is learned from, and bytes of text of each.
TABLE_PARTS, TABLE_BYTES = 8, 4 << 20
#: Chunks longer than this never enter the table.
LONGEST_CHUNK = 64


def frequent_chunks(docs: DataFrame, entries: int = TABLE_ENTRIES) -> list[bytes]:
    """The most frequent chunks of a bounded part of the texts.

    Every task gives one row, its ``entries`` most frequent chunks with their counts, and ``take`` runs no more tasks
    than it needs rows, so nothing is shuffled and the driver merges ``TABLE_PARTS`` bounded tables.
    """

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        left = TABLE_BYTES
        for piece in (p for batch in batches for text in bytes_of(batch, "text") for p in pieces(text)):
            counts.update(CHUNK.findall(piece))
            left -= len(piece)
            if left <= 0:
                break
        top = heapq.nlargest(entries, ((n, c) for c, n in counts.items() if n > 1 and len(c) <= LONGEST_CHUNK))
        if top:
            yield pa.RecordBatch.from_pydict(
                {"chunks": pa.array([[c for _, c in top]], pa.list_(pa.binary())), "n": pa.array([[n for n, _ in top]], pa.list_(pa.int64()))}
            )

    merged: Counter = Counter()
    for row in docs.select("text").mapInArrow(heavy, "chunks array<binary>, n array<bigint>").take(TABLE_PARTS):
        merged.update(dict(zip(map(bytes, row.chunks), row.n, strict=True)))
    return [c for _, c in heapq.nlargest(entries, ((n, c) for c, n in merged.items()))]


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 512,
    entries: int = TABLE_ENTRIES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    A null text counts as empty (0 bytes, 0 tokens). A null id stays null. Repeated rows each give a row. Other
    columns are not read. An empty table gives an empty result.
    """
    rows = documents(docs, id_col, text_col)
    chunks = frequent_chunks(rows, entries)
    lengths = ChunkLengths(tokenizer_path, {})
    ready = {c: n for c in chunks if (n := lengths.measure(c)) < ChunkLengths.MIXED}
    sent, name = docs.sparkSession.sparkContext.broadcast(ready), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunk_lengths(tokenizer_path, name, lambda: sent.value)
        for batch in batches:
            texts = bytes_of(batch, "text")
            n = [own.count(x) for x in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array(map(len, texts), pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "over_limit": pa.array([x > limit for x in n], pa.bool_()),
                }
            )

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
