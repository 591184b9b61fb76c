"""Quality rules: counts on whole texts, and a calibrated logistic regression over word and character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from deckloom.llm.common import documents, pieces, table
from deckloom.llm.linear import Model, Rows, calibrate, fit, fitted, labelled_sample
from deckloom.llm.ngrams import Distinct, buckets, char_buckets, code_points, runs, word_hashes

CHAR_ORDERS = (3, 4)
#: Labelled rows that are used at most, by class: for training, and held out for calibration.
TRAINING_ROWS = {1: 2500, 0: 2500}
CALIBRATION_ROWS = {1: 800, 0: 800}
#: Rules with fixed thresholds.
LEAST_WORDS, MOST_REPEATED_PERCENT, LEAST_PROBABILITY = 50, 50, 0.5
_SYMBOLS = b"#*$%&|<>"

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, probability double"
)


def all_word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a whole text, a piece of it at a time."""
    return np.concatenate([word_hashes(piece)[:, 0] for piece in pieces(text)])


def features() -> Callable[..., np.ndarray]:
    """A function from a whole text (and its word hashes, if at hand) to its distinct buckets of words, word pairs and
    character n-grams, as they are written, but with one space between words."""
    distinct = Distinct()

    def of(text: str, words: np.ndarray | None = None) -> np.ndarray:
        words = all_word_hashes(text.encode()) if words is None else words
        parts = [buckets(words), buckets(runs(words, 2))]
        for found in char_buckets(code_points(" ".join(text.split())), CHAR_ORDERS):
            parts.append(found)
            if len(parts) == 16:  # very long texts: distinct buckets are bounded, n-grams aren't
                parts = [distinct(parts)]
        return distinct(parts)

    return of


def base_counts(text: bytes, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text with these word hashes."""
    code_points = len(text) - sum(text.count(bytes([c])) for c in b" \t\n\x0b\x0c\r")
    code_points -= int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 3:
        _, where, count = np.unique(runs(words, 3), return_inverse=True, return_counts=True)
        again = count[where] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        repeated = int(covered.sum())
    return len(words), code_points, symbols, len(lines) - len(set(lines)), repeated


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of labelled rows, its probabilities calibrated on a bounded held-out sample.

    Both samples are weighted to the classes' ratio among all labelled rows.
    """

    def learn(found: Rows, y: np.ndarray, times: np.ndarray, held_out: np.ndarray) -> Model:
        part = [(Rows([x for x, own in zip(found.rows, which, strict=True) if own]), y[which], times[which]) for which in (~held_out, held_out)]
        return calibrate(fit(*part[0][:2], log_count_ratio=False, times=part[0][2]), *part[1])

    return fitted(labelled_sample(docs, labels, "quality", features, TRAINING_ROWS, CALIBRATION_ROWS), learn)


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the calibrated ``probability`` of good quality, for every row.

    A null text has no words, fails the base rules and isn't kept. A null id stays null; repeated rows each give a row,
    an empty table none. Other columns are not read. Words are compared by 64-bit hashes within one text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = features(), sent.value
        for batch in batches:
            out = []
            for text in map(pa.StringScalar.as_py, batch.column("text")):
                data = text.encode()
                words = all_word_hashes(data)
                base = base_counts(data, words)
                failed = base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED_PERCENT * base[0]
                p = own.probability(of(text, words))
                out.append((*base, failed, not failed and p >= LEAST_PROBABILITY, p))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"],
            )

    return documents(docs, id_col, text_col).mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
