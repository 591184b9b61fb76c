"""Packing documents into fixed windows by the sum-of-squares rule.

Each task packs the documents of its own partition online, so nothing is shuffled. A document first fills whole windows
by itself. What is left goes to the fill level that makes the sum of squared counts of partly filled windows smallest;
an array holds the number of such windows at each level.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.llm.common import bytes_of, documents, table
from deckloom.llm.tokens import word_encoder

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Pieces in one Arrow batch of results; at most this many windows' ids are held.
BATCH_PIECES = 512


class LevelPacker:
    """Partly filled windows by fill level. A piece is ``(doc_id, start, doc_tokens, ids)``."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, list[list[tuple]]] = {}

    def level_for(self, size: int) -> int:
        """The fill level to add to (0: a new window), fullest first among equals.

        Moving a window from level h to h+size changes the sum of squares by 2(N[h+size] - N[h]) + 2; filling it up
        by 1 - 2 N[h]; opening one by 2 N[size] + 1.
        """
        at = np.flatnonzero(self.counts[: self.capacity - size + 1])
        if not len(at):
            return 0
        to = at + size
        change = np.where(to == self.capacity, 1, 2 * self.counts[to] + 2) - 2 * self.counts[at]
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(at[best]) if change[best] <= 2 * self.counts[size] + 1 else 0

    def place(self, piece: tuple) -> list[tuple] | None:
        """Add a piece shorter than a window; returns the window's pieces if that fills it."""
        size = len(piece[3])
        level = self.level_for(size)
        window: list[tuple] = []
        if level:
            window = self.windows[level].pop()
            self.counts[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.windows.setdefault(level + size, []).append(window)
        self.counts[level + size] += 1
        return None

    def rest(self) -> Iterator[list[tuple]]:
        """Fill partly filled windows, fullest first, with pieces cut from the emptiest; what is left goes into powers of two.

        So windows keep what the level rule put into them, and only as many are taken apart as it takes to fill the others.
        """
        open_ = deque(w for level in sorted(self.windows, reverse=True) for w in self.windows[level])
        loose: deque[tuple] = deque()

        def taken(room: int) -> Iterator[tuple]:
            while room and (loose or open_):
                if not loose:
                    loose.extend(open_.pop())
                doc, start, n, ids = loose.popleft()
                if len(ids) > room:
                    loose.appendleft((doc, start + room, n, ids[room:]))
                    ids = ids[:room]
                room -= len(ids)
                yield doc, start, n, ids

        window: list[tuple] = []
        while open_:
            window = open_.popleft()
            window.extend(taken(self.capacity - sum(len(p[3]) for p in window)))
            if sum(len(p[3]) for p in window) == self.capacity:
                yield window
                window = []
        loose.extendleft(reversed(window))
        left = sum(len(p[3]) for p in loose)
        for k in range(self.capacity.bit_length(), -1, -1):
            if left >> k & 1:
                yield list(taken(1 << k))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece of a document: where its ids lie in which window, with the ids as bytes.

    ``ids`` are little-endian unsigned 32-bit integers. Every document ends with ``end_id``; a null text is empty and
    has only that id. Each id lies in exactly one piece. Windows hold ``capacity`` ids, but for those that take the
    last ids of a partition, whose lengths are powers of two. Sequence ids are unique, not dense. Rows with equal or
    null ids are packed as documents of their own. Other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, out = word_encoder(tokenizer_path), LevelPacker(capacity), []
        number = TaskContext.get().partitionId() << 40

        def emit(window: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for doc, start, n, ids in window:
                out.append((doc, start, len(ids), n, number, offset, ids.astype("<u4").tobytes()))
                offset += len(ids)
            number += 1

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode(bytes_of(batch, "text")), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                n, whole = len(ids), len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    emit([(doc, start, n, ids[start : start + capacity])])
                if n > whole and (full := packer.place((doc, whole, n, ids[whole:].copy()))):
                    emit(full)
                while len(out) >= BATCH_PIECES:
                    yield _piece_batch(out[:BATCH_PIECES])
                    del out[:BATCH_PIECES]
        for window in packer.rest():
            emit(window)
            if len(out) >= BATCH_PIECES:
                yield _piece_batch(out)
                out.clear()
        if out:
            yield _piece_batch(out)

    return documents(docs, id_col, text_col).mapInArrow(run, PIECE)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names
    )


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with the unsigned CRC-32 of their ids in place of the ids."""
    columns = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    return packed.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
