"""Removal of repeated word sequences, found by difference-cover anchors.

A set D is a difference cover modulo P if for any two positions i and j some shift k < P puts both i+k and j+k, modulo
P, into D. So two equal runs of ``window`` words always share an anchor (a run of ``window - P + 1`` words) that starts
at cover positions of both, wherever the runs lie. Only these positions are hashed and compared.

1. Each task hashes its texts' anchors. Anchors that it sees twice are known to repeat; of each anchor, one row is
   compared with other tasks' rows. A task remembers its most frequent anchors, so of these it sends one row in all,
   of others one for each of its batches at most.
2. Where an anchor repeats, the windows that contain it are candidates. The match is extended to the whole window by
   comparing 96 bits of two independent hashes of its words, again with one row for each window and batch.
3. All but the earliest of equal windows are marked, and the words that they cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.llm.common import bytes_of, documents, fresh, pieces, stored, table
from deckloom.llm.ngrams import mixed, runs, word_hashes

WINDOW = 20
#: A perfect difference set, {0, 1, 3, 9} modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)

#: Stands for a null id in comparisons.
NO_ID = -(1 << 63)
_ANCHOR = "anchor long, k long, th binary, pos int, known boolean"
_FOUND = "w1 long, w2 int, k long, th binary, start int, n int, known boolean"
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _hashes(text: bytes) -> np.ndarray:
    parts = [word_hashes(piece) for piece in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _first_of_equal(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return new


def _marked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str, str]:
    """The rows with two more columns that tell documents apart, these columns' names, and a name for one more.

    The first is the id (null is least), the second 128 bits of the text's SHA-256 if any id repeats, else empty.
    """
    key, text_hash, spans = fresh(docs, "__k", "__th", "__spans")
    most = docs.groupBy(F.col(id_col).alias("k")).count().agg(F.max("count")).first()[0] or 0
    th = F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 32)) if most > 1 else F.lit(b"")
    rows = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), text_hash: th})
    return rows, key, text_hash, spans


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The rows with one more column, their document's repeats (null if none), and its name."""
    marked, key, text_hash, spans = _marked(docs, id_col, text_col)
    places = marked.select(F.col(key).alias("__k"), F.col(text_hash).alias("__th"), F.col(text_col).alias("__text"))
    found = repeated_spans(places).toDF(key, text_hash, spans)
    return marked.join(found, [key, text_hash], "left").drop(key, text_hash), spans


class _Hot:
    """Keys that were frequent in some batch of a task, with the least place they were sent with; bounded in number.

    Later rows of such a key are known to repeat, so a task sends one row of it, and not one for each batch.
    """

    def __init__(self, most: int = 1 << 16, frequent: int = 8):
        self.most, self.frequent = most, frequent
        self.least: dict[int, tuple] = {}

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are held."""
        held = np.fromiter(self.least, np.uint64, len(self.least))
        return np.isin(keys, held) if len(held) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, counts: np.ndarray, places: list[np.ndarray]) -> None:
        """Hold frequent keys (and new least places of held ones) until there are as many as may be held."""
        for i in np.flatnonzero((counts >= self.frequent) | self.known(keys)).tolist():
            if len(self.least) >= self.most:
                break
            self.least[int(keys[i])] = tuple(x[i].item() for x in places)


def repeated_spans(marked: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """``__k, __th, __spans``: for each document with repeats, runs (start, n) of windows that also start earlier.

    Takes rows ``__k, __th, __text``.

    Earlier is a smaller ``(__k, __th)``, or an earlier start in the same document. What one step finds is written
    before the next begins, so that the shuffle files of both never lie on disk together.
    """
    anchor = window - period + 1
    at_cover = np.zeros(period, bool)
    at_cover[list(cover)] = True

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _Hot()
        for batch in batches:
            found, doc, pos = [], [], []
            for i, text in enumerate(bytes_of(batch, "__text")):
                h = runs(_hashes(text)[:, 0], anchor)
                where = np.flatnonzero(np.resize(at_cover, len(h))) if len(h) else np.zeros(0, np.int64)
                found.append(h[where])
                doc.append(np.full(len(where), i, np.int64))
                pos.append(where)
            h, doc, pos = mixed(np.concatenate(found)), np.concatenate(doc), np.concatenate(pos)
            order = np.argsort(h, kind="stable")
            place = np.argsort(order, kind="stable")  # rows are sent in the order of texts, in which they compress well
            h, doc, pos = h[order], doc[order], pos[order]
            first = _first_of_equal(h)
            group = np.cumsum(first) - 1
            if not len(h):
                continue
            size = np.bincount(group)
            sent_before = hot.known(h[first])
            known = (size > 1)[group] | sent_before[group]
            hot.add(h[first], size, [])
            first[first] = ~sent_before
            alone = mixed((doc.astype(np.uint64) << np.uint64(32)) ^ pos.astype(np.uint64) ^ (h * _SECOND))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(first, h, alone)[place].view(np.int64)),
                    batch.column("__k").take(pa.array(doc[place])),
                    batch.column("__th").take(pa.array(doc[place])),
                    pa.array(pos[place].astype(np.int32)),
                    pa.array(known[place]),
                ],
                names=["anchor", "k", "th", "pos", "known"],
            )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _Hot()
        for batch in batches:
            k, th = batch.column("__k").to_numpy(), np.array(batch.column("__th").to_pylist(), "S16")
            texts, flagged = bytes_of(batch, "__text"), batch.column("__anchors")
            w1, w2, doc, start = [], [], [], []
            order = np.lexsort((th, k))
            new = _first_of_equal(k[order], th[order])
            number = np.cumsum(new) - 1
            for o, i in zip(number[new].tolist(), order[new].tolist(), strict=True):
                h = _hashes(texts[i])
                n = len(h) - window + 1
                at = np.asarray(flagged[i].as_py(), np.int64)
                at = at[at < len(h)]
                if n <= 0 or not len(at):
                    continue
                mark = np.zeros(len(h) + 2, np.int64)
                np.add.at(mark, np.maximum(at - period + 1, 0), 1)
                np.add.at(mark, at + 1, -1)
                here = np.flatnonzero(np.cumsum(mark)[:n] > 0)
                w1.append(runs(h[:, 0], window)[here])
                w2.append(runs(h[:, 1], window)[here])
                doc.append(np.full(len(here), o, np.int64))
                start.append(here)
            if not w1:
                continue
            w1, w2, doc, start = map(np.concatenate, (w1, w2, doc, start))
            row = order[new][doc]  # documents come in order, so rows are in order of (k, th, start)
            by = np.argsort(w1, kind="stable")
            new_key = _first_of_equal(w1[by], w2[by])
            head = by[new_key]  # the earliest of each window in this batch
            size = np.diff(np.append(np.flatnonzero(new_key), len(by)))
            pair = w1[head] ^ mixed(w2[head])
            place = [k[row[head]], th[row[head]], start[head]]
            after = hot.known(pair)
            for i in np.flatnonzero(after).tolist():
                after[i] = hot.least[int(pair[i])] < tuple(x[i].item() for x in place)
            hot.add(pair[~after], size[~after], [x[~after] for x in place])
            first = np.zeros(len(w1), bool)
            first[head] = ~after
            later = np.flatnonzero(~first)
            run = np.ones(len(later), bool)
            run[1:] = (doc[later][1:] != doc[later][:-1]) | (start[later][1:] != start[later][:-1] + 1)
            length = np.diff(np.append(np.flatnonzero(run), len(later)))
            sent = np.concatenate([np.flatnonzero(first), later[run]])
            known = np.arange(len(sent)) >= int(first.sum())
            alone = mixed((row[sent].astype(np.uint64) << np.uint64(32)) ^ start[sent].astype(np.uint64) ^ (w2[sent] * _SECOND))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(known, alone, w1[sent]).view(np.int64)),
                    pa.array((np.where(known, mixed(alone), w2[sent]) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.array(k[row[sent]]),
                    batch.column("__th").take(pa.array(row[sent])),
                    pa.array(start[sent].astype(np.int32)),
                    pa.array(np.concatenate([np.ones(int(first.sum()), np.int32), length.astype(np.int32)])),
                    pa.array(known),
                ],
                names=["w1", "w2", "k", "th", "start", "n", "known"],
            )

    rows = marked.select("__k", "__th", "__text")
    hashed = rows.mapInArrow(anchors, _ANCHOR)
    compared = hashed.withColumn("rows", F.count("*").over(Window.partitionBy("anchor"))).filter("known or rows > 1")
    repeated = compared.groupBy(F.col("k").alias("__k"), F.col("th").alias("__th")).agg(F.collect_list("pos").alias("__anchors"))
    found = rows.join(stored(repeated, "anchors"), ["__k", "__th"]).mapInArrow(windows, _FOUND)
    place = F.struct("k", "th", "start")
    least = F.min(place).over(Window.partitionBy("w1", "w2"))
    later = found.withColumn("least", least).filter(F.col("known") | (place > F.col("least")))
    spans = F.collect_list(F.struct("start", "n")).alias("__spans")
    return stored(later.groupBy(F.col("k").alias("__k"), F.col("th").alias("__th")).agg(spans), "spans")


def covered_words(n_words: int, spans: list[dict] | None, window: int = WINDOW) -> np.ndarray:
    """Which words the windows of the spans cover."""
    edge = np.zeros(n_words + 1, np.int64)
    if spans:
        start = np.array([s["start"] for s in spans])
        end = np.minimum(start + np.array([s["n"] for s in spans]) + window - 1, n_words)
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
    return np.cumsum(edge)[:n_words] > 0


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row: what is left after removing repeats.

    A null text has no words. Null ids are one least id. Of rows with equal ids and different texts, those with the
    smaller text hash come first; rows equal in both are one document, treated alike. An empty table gives no rows.
    Other columns are not read. Windows are compared by 96 bits of two independent hashes of their words.
    """
    rows, spans_col = _with_spans(documents(docs, id_col, text_col), "doc_id", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(bytes_of(batch, "text"), batch.column(spans_col).to_pylist(), strict=True):
                words = text.split()
                kept = words
                if spans:
                    kept = [w for w, c in zip(words, covered_words(len(words), spans).tolist(), strict=True) if not c]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return rows.select("doc_id", "text", spans_col).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The rows with all their columns, repeats cut from the text; ``chars_col``, if given, is set to its new length.

    A text without repeats stays as it is; of others the kept words are joined by one space. Rows stay even if no word
    is left. Nulls and repeated rows are treated as in ``removal_digest``. Columns may have any name.
    """
    rows, spans_col = _with_spans(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(text_col).to_pylist()
            for i, spans in enumerate(batch.column(spans_col).to_pylist()):
                if spans:
                    words = texts[i].encode().split()
                    gone = covered_words(len(words), spans).tolist()
                    texts[i] = b" ".join(w for w, c in zip(words, gone, strict=True) if not c).decode()
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            kept = [i for i, name in enumerate(batch.schema.names) if name != spans_col]
            yield pa.RecordBatch.from_arrays([columns[i] for i in kept], names=[batch.schema.names[i] for i in kept])

    result = rows.mapInArrow(cut, docs.schema)
    return result if chars_col is None else result.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents"))
