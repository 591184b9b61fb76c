"""Logistic regression over hashed binary features, fitted in a task on a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.llm.common import documents
from deckloom.llm.ngrams import BITS

#: Features that a block of rows has at most in a fitting step, beyond its first row's.
BLOCK_FEATURES = 1 << 19
_BITMAP_BYTES = (1 << BITS) // 8
_HIGH = np.arange(1 << (BITS - 16), dtype=np.int32) << 16


def packed(found: np.ndarray) -> bytes:
    """All of a row's distinct buckets in 2**BITS / 8 bytes at most.

    These are the low 16 bits of the sorted buckets, behind the count of each value of the high bits, or else a bitmap.
    """
    if 4 * len(_HIGH) + 2 * len(found) < _BITMAP_BYTES:
        found = np.sort(found)
        return np.bincount(found >> 16, minlength=len(_HIGH)).astype("<u4").tobytes() + found.astype("<u2").tobytes()
    bits = np.zeros(1 << BITS, bool)
    bits[found] = True
    return np.packbits(bits).tobytes()


class Rows(Sequence):
    """Rows of buckets, kept packed; each is unpacked when it is asked for."""

    def __init__(self, rows: list[bytes]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> np.ndarray:
        row = self.rows[k]
        if len(row) == _BITMAP_BYTES:
            return np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8))).astype(np.int32)
        counts = np.frombuffer(row, "<u4", len(_HIGH))
        return np.frombuffer(row, "<u2", offset=counts.nbytes) + np.repeat(_HIGH, counts)


@dataclass
class Model:
    """``weights[bucket]`` and a bias; a text's score is their sum over its distinct buckets, over a root of their number."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, found: np.ndarray) -> float:
        raw = self.bias
        if len(found):
            raw += float(self.weights[found].sum(dtype=np.float64)) / len(found) ** 0.5
        return self.slope * raw + self.shift

    def probability(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(found), -40, 40))))


def fold(doc_id: Column) -> Column:
    """Remainder by 5 of the CRC-32 of the id as text; rows with 0 are held out from training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, training: dict[int, int], held_out: dict[int, int] | None = None) -> DataFrame:
    """``held_out, y, times, text`` of at most ``training[c]`` labelled rows of each class c, by a hash of the id.

    With ``held_out`` as many rows at most of each class are added from those held out. ``times`` is the number of
    labelled rows of the row's class (and fold) over the number chosen of them, so that the classes keep the ratio they
    have in the whole table where the bound takes a smaller part of one than of the other.

    Only the chosen ids are broadcast, so the texts of other documents are neither shuffled nor collected. Rows with a
    null label or id are passed over; an id labelled twice counts once, with its larger label; of documents with one
    id, the first by hash of the text counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("held_out", fold(F.col("doc_id")) == 0)
    counts = {(r.held_out, r.y): r.n for r in rows.groupBy("held_out", "y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for held, bounds in ((False, training), (True, held_out or {})):
        for value, most in bounds.items():
            part = rows.filter((F.col("held_out") == held) & (F.col("y") == value)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
            part = part.withColumn("times", F.lit(max(1.0, counts.get((held, value), 0) / most)))
            chosen = part if chosen is None else chosen.unionByName(part)
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    texts = documents(docs).join(F.broadcast(chosen), "doc_id").withColumn("n", F.row_number().over(once))
    return texts.filter("n = 1").select("held_out", "y", "times", "text")


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    features: Callable[[], Callable[[str], np.ndarray]],
    training: dict[int, int],
    held_out: dict[int, int] | None = None,
) -> DataFrame:
    """``held_out, y, times, found``: the rows of ``labelled_texts`` with packed features instead of texts."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features()
        for batch in batches:
            found = pa.array([packed(of(x.as_py())) for x in batch.column("text")], pa.binary())
            kept = [batch.column(c) for c in ("held_out", "y", "times")]
            yield pa.RecordBatch.from_arrays([*kept, found], names=["held_out", "y", "times", "found"])

    texts = labelled_texts(docs, labels, label, training, held_out)
    return texts.mapInArrow(extract, "held_out boolean, y int, times double, found binary")


def fitted(sample: DataFrame, learn: Callable[[Rows, np.ndarray, np.ndarray, np.ndarray], Model]) -> Model:
    """The model that ``learn(rows, y, times, held_out)`` makes of a bounded sample, in one task of an executor.

    The task takes the packed rows in, 128 KB at most for each; the driver gets the model alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, parts = [], []
        for batch in batches:
            found += batch.column("found").to_pylist()
            parts.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "times", "held_out")])
        y, times, held = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 3
        order = sorted(range(len(found)), key=lambda i: (y[i], found[i]))  # sums come out the same in every run
        model = learn(Rows([found[i] for i in order]), y[order].astype(float), times[order].astype(float), held[order].astype(bool))
        yield pa.RecordBatch.from_pylist(
            [{"weights": model.weights.astype("<f4").tobytes(), "bias": model.bias, "slope": model.slope, "shift": model.shift}]
        )

    got = sample.repartition(1).mapInArrow(run, "weights binary, bias double, slope double, shift double").first()
    if got is None:
        return learn(Rows([]), np.zeros(0), np.zeros(0), np.zeros(0, bool))
    return Model(np.frombuffer(got.weights, "<f4"), got.bias, got.slope, got.shift)


def fit(
    rows: Sequence[np.ndarray],
    y: np.ndarray,
    log_count_ratio: bool,
    steps: int = 40,
    rate: float = 0.3,
    l2: float = 1e-6,
    even: float = 0.0,
    times: np.ndarray | None = None,
) -> Model:
    """Full-batch logistic regression by Adam; the data are walked in blocks, so little more than they is held.

    With ``log_count_ratio`` every feature is scaled by the logarithm of its smoothed share among positive rows over
    that among negative rows. ``times[i]`` (1 if not given) says how many rows row i stands for; the rows are fitted
    as they are, and the bias is then moved by the change of the classes' log ratio, as far as ``even`` leaves it to them:
    steps that would be too few for very unequal weights are enough then. Without both classes the model is the smoothed prior (under one half with no rows).
    """
    size = 1 << BITS
    times = np.ones(len(y)) if times is None else times
    w, b = np.zeros(size, np.float32), float(np.log((times @ y + 0.5) / (times @ (1 - y) + 1)))
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(w, b)
    ratio = np.ones(size, np.float32)
    if log_count_ratio:
        share = []
        for value in (1, 0):
            counts = np.ones(size)
            for x in (r for r, label in zip(rows, y, strict=True) if label == value):
                counts[x] += 1
            share.append(counts / ((y == value).sum() + 2))
        ratio = np.log(share[0] / share[1]).astype(np.float32)
    share_of = y.mean()
    weight = np.where(y == 1, 0.5 / share_of, 0.5 / (1 - share_of)) ** even
    weight /= weight.sum()
    starts, held = [0], 0
    for k, x in enumerate(rows):
        if held and (held + len(x) > BLOCK_FEATURES or k - starts[-1] == 256):
            starts, held = [*starts, k], 0
        held += len(x)
    ends = [*starts[1:], len(rows)]
    m, v, mb, vb, b = np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0, 0.0
    for step in range(1, steps + 1):
        grad, grad_b = l2 * w, 0.0
        scaled = w * ratio
        for first, end in zip(starts, ends, strict=True):
            block = [rows[k] for k in range(first, end)]
            n = np.array([len(x) for x in block])
            flat = np.concatenate(block)
            root = 1 / np.sqrt(np.maximum(n, 1))
            row = np.repeat(np.arange(len(block), dtype=np.int32), n)
            z = np.bincount(row, scaled[flat], len(block)) * root + b
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[first:end]) * weight[first:end]
            grad += np.bincount(flat, (off * root)[row], size).astype(np.float32) * ratio
            grad_b += off.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b**2
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w -= (rate * (m / a) / (np.sqrt(v / c) + 1e-8)).astype(np.float32)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    b += (1 - even) * (np.log((times @ y) / (times @ (1 - y))) - np.log(share_of / (1 - share_of)))
    return Model(w * ratio, float(b))


def calibrate(model: Model, rows: Sequence[np.ndarray], y: np.ndarray, times: np.ndarray | None = None) -> Model:
    """Platt scaling on rows that the model wasn't fitted on; needs both classes, else the model stays as it is.

    Row i counts ``times[i]`` times (once if not given), scaled to a mean of one. Newton steps that overshoot are halved.
    """
    if not len(y) or not 0 < y.sum() < len(y):
        return model
    weight = np.ones(len(y)) if times is None else times / times.mean()
    z = np.array([model.margin(x) for x in rows])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, a = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])

    def loss(a: np.ndarray) -> float:
        return weight @ (np.logaddexp(0, x @ a) - target * (x @ a)) + 5e-4 * ((a - [1, 0]) ** 2).sum()

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * (a - [1, 0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        while loss(a - step) > loss(a) and np.abs(step).max() > 1e-9:
            step = step / 2
        a = a - step
    return Model(model.weights, model.bias, max(float(a[0]), 1e-3), float(a[1]))
