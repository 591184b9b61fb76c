"""Quality by a small convolutional network over the bytes of whole texts, in numpy.

Each byte has a learned vector; learned filters run over every 6 bytes; overlapping chunks of 128 places, half of each shared
with the next, cover the whole text. A filter's greatest value in a chunk feeds hidden units of the chunk, a unit's greatest
value over all chunks feeds the probability. Filters see what a passage consists of, hidden units what it lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.llm.common import bytes_of, documents, table
from deckloom.llm.linear import fold, labelled_texts

WIDTH, DEPTH, FILTERS, HIDDEN = 6, 8, 32, 16
HALF = 64
CHUNK = 2 * HALF
#: Stands behind a text that is shorter than a chunk.
PADDING = 256
#: Places that filters are applied to at once.
BLOCK = 128 * HALF
#: Bounds on the labelled rows that are used for training: rows of a class, bytes of a row's text, bytes of a class's texts.
TRAINING_ROWS = {1: 1500, 0: 1500}
TRAINING_ROW_BYTES, TRAINING_BYTES = 1 << 20, 24 << 20
STEPS, BATCH, RATE, SEED = 560, 32, 0.01, 0
LEAST_PROBABILITY = 0.3

RESULT = "doc_id long, held_out boolean, score double, predicted int"


def codes(text: bytes) -> np.ndarray:
    """A text's bytes, padded to one chunk at least."""
    x = np.frombuffer(text, np.uint8).astype(np.int16)
    short = CHUNK + WIDTH - 1 - len(x)
    return np.concatenate([x, np.full(short, PADDING, np.int16)]) if short > 0 else x


@dataclass
class Net:
    """Byte vectors, filters, hidden units and the last layer; ``bias`` has one number."""

    vectors: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    units: np.ndarray
    unit_bias: np.ndarray
    last: np.ndarray
    bias: np.ndarray

    def places(self, x: np.ndarray) -> np.ndarray:
        """``[place, WIDTH * DEPTH]``: the vectors of each ``WIDTH`` bytes in a row."""
        found = self.vectors[x]
        return np.lib.stride_tricks.as_strided(found, (len(x) - WIDTH + 1, WIDTH * DEPTH), found.strides, writeable=False)

    def filtered(self, x: np.ndarray) -> np.ndarray:
        return self.places(x) @ self.filters + self.filter_bias

    def chunks(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.units + self.unit_bias

    def log_odds(self, text: bytes) -> float:
        """Of a whole text, a block of it at a time."""
        x = codes(text)
        count = len(x) - WIDTH + 1
        most, edge = np.zeros(HIDDEN, np.float32), np.zeros((0, FILTERS), np.float32)
        for first in range(0, count, BLOCK):
            z = self.filtered(x[first : first + BLOCK + WIDTH - 1])
            whole = len(z) // HALF
            halves = np.concatenate([edge, z[: whole * HALF].reshape(whole, HALF, FILTERS).max(axis=1)])
            if len(halves) > 1:
                most = np.maximum(most, self.chunks(np.maximum(halves[:-1], halves[1:])).max(axis=0))
            edge = halves[-1:]
        if count % HALF:  # the last chunk ends with the text
            most = np.maximum(most, self.chunks(self.filtered(x[-(CHUNK + WIDTH - 1) :]).max(axis=0)))
        return float(most @ self.last + self.bias[0])

    def probability(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.log_odds(text), -40, 40))))


def arrays_of(net: Net) -> list[np.ndarray]:
    return [net.vectors, net.filters, net.filter_bias, net.units, net.unit_bias, net.last, net.bias]


def started(rng: np.random.Generator) -> Net:
    def normal(scale: float, *shape: int) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    return Net(
        normal(0.5, PADDING + 1, DEPTH),
        normal(1.4 / (WIDTH * DEPTH) ** 0.5, WIDTH * DEPTH, FILTERS),
        np.zeros(FILTERS, np.float32),
        normal(FILTERS**-0.5, FILTERS, HIDDEN),
        np.full(HIDDEN, 0.1, np.float32),
        normal(0.3, HIDDEN),
        np.zeros(1, np.float32),
    )


def add_gradient(net: Net, into: Net, x: np.ndarray, y: float) -> None:
    """Add the gradient of one text's log loss: it runs through each unit's best chunk and each filter's best place there."""
    z = net.filtered(x)
    first = np.arange(0, len(z) - CHUNK + 1, HALF)
    if first[-1] + CHUNK < len(z):
        first = np.append(first, len(z) - CHUNK)
    whole = len(z) // HALF
    halves = z[: whole * HALF].reshape(whole, HALF, FILTERS).max(axis=1)
    pooled = np.maximum(halves[:-1], halves[1:])
    if len(pooled) < len(first):
        pooled = np.concatenate([pooled, z[-CHUNK:].max(axis=0)[None]])
    pooled = np.maximum(pooled, 0)
    units = pooled @ net.units + net.unit_bias
    best = units.argmax(axis=0)
    most = np.maximum(units[best, np.arange(HIDDEN)], 0)
    odds = float(most @ net.last + net.bias[0])
    off = np.float32(1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y)
    into.bias += off
    into.last += off * most
    at_units = off * net.last * (most > 0)
    into.unit_bias += at_units
    into.units += pooled[best].T * at_units
    used, which = np.unique(best, return_inverse=True)
    at_chunks = np.zeros((len(used), FILTERS), np.float32)
    np.add.at(at_chunks, which, at_units[:, None] * net.units.T)
    at_chunks *= pooled[used] > 0
    into.filter_bias += at_chunks.sum(axis=0)
    place = np.stack([first[c] + z[first[c] : first[c] + CHUNK].argmax(axis=0) for c in used])
    taken = x[place[..., None] + np.arange(WIDTH)]
    found = net.vectors[taken].reshape(len(used), FILTERS, -1)
    into.filters += np.einsum("cfk,cf->kf", found, at_chunks)
    back = (at_chunks[..., None] * net.filters.T).reshape(*taken.shape, DEPTH)
    np.add.at(into.vectors, taken, back)


def fit(texts: list[bytes], y: np.ndarray, times: np.ndarray, steps: int = STEPS) -> Net:
    """A network fitted by Adam to texts and labels, the same in every run; few texts come round the more often.

    ``times[i]`` says how many rows row i stands for; the classes' ratio that follows is put into the bias at the end.
    Without both classes every text gets the smoothed share of label 1 (under one half with no rows).
    """
    rng = np.random.default_rng(SEED)
    net = started(rng)
    prior = np.log((times @ y + 0.5) / (times @ (1 - y) + 1))
    if not len(y) or not 0 < y.sum() < len(y):
        net.last[:], net.bias[:] = 0, prior
        return net
    rows = [codes(t) for t in texts]
    weights = arrays_of(net)
    m, v = ([np.zeros_like(w) for w in weights] for _ in range(2))
    order = np.zeros(0, int)
    for step in range(1, steps + 1):
        if len(order) < BATCH:  # rows come round in a new order each time
            order = np.concatenate([order, rng.permutation(len(rows))])
        batch, order = order[:BATCH], order[BATCH:]
        grad = Net(*(np.zeros_like(w) for w in weights))
        for i in batch:
            add_gradient(net, grad, rows[i], y[i])
        rate = RATE * min(1.0, 1.2 * (steps - step + 1) / steps)
        for w, g, a, b in zip(weights, arrays_of(grad), m, v, strict=True):
            g /= len(batch)
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= (rate / (1 - 0.9**step)) * a / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.bias += np.float32(np.log((times @ y) / (times @ (1 - y))) - np.log(y.mean() / (1 - y.mean())))
    return net


def training_texts(docs: DataFrame, labels: DataFrame, rows: dict[int, int] = TRAINING_ROWS) -> DataFrame:
    """``y, times, text`` of labelled rows that aren't held out, within the documented bounds, whole texts only."""
    texts = labelled_texts(docs, labels, "quality", rows).select("y", "times", "text", F.octet_length("text").cast("long").alias("bytes"))
    so_far = Window.partitionBy("y").orderBy(F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, 0)
    texts = texts.filter(F.col("bytes") <= TRAINING_ROW_BYTES).withColumn("so_far", F.sum("bytes").over(so_far))
    return texts.filter(F.col("so_far") <= TRAINING_BYTES).select("y", "times", "text")


def train(docs: DataFrame, labels: DataFrame, rows: dict[int, int] = TRAINING_ROWS, steps: int = STEPS) -> Net:
    """A network fitted in one task of an executor; the driver gets its weights alone, some 24 KB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, times = [], [], []
        for batch in batches:
            texts += bytes_of(batch, "text")
            y += batch.column("y").to_pylist()
            times += batch.column("times").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (y[i], texts[i]))  # whatever order rows come in
        net = fit([texts[i] for i in order], np.array([y[i] for i in order], float), np.array([times[i] for i in order], float), steps)
        yield pa.RecordBatch.from_pylist([{"part": k, "weights": w.astype("<f4").tobytes()} for k, w in enumerate(arrays_of(net))])

    got = training_texts(docs, labels, rows).repartition(1).mapInArrow(run, "part long, weights binary").collect()
    if not got:
        return fit([], np.zeros(0), np.zeros(0))
    shapes = [w.shape for w in arrays_of(started(np.random.default_rng(SEED)))]
    return Net(*(np.frombuffer(r.weights, "<f4").reshape(shapes[r.part]) for r in sorted(got, key=lambda r: r.part)))


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, from the bytes of its whole text alone.

    A null text is scored as an empty one, which is all padding. A null id stays null and isn't held out. Repeated rows each
    give a row, and an empty table none. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            p = np.array([own.probability(x) for x in bytes_of(batch, "text")], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= LEAST_PROBABILITY).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return documents(docs, id_col, text_col).select("doc_id", held, "text").mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
