"""Toxicity by character n-grams scaled by naive Bayes log-count ratios, in a linear classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.llm.common import documents, table
from deckloom.llm.linear import Model, Rows, fit, fitted, fold, labelled_sample
from deckloom.llm.ngrams import Distinct, char_buckets, code_points

ORDERS = (4, 6, 8)
#: Labelled rows that are used for training at most, by class.
TRAINING_ROWS = {1: 1500, 0: 3500}
#: Of the ASCII characters, lower-case letters stay; all else is a space.
_LETTERS = np.array([c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)


def plain(text: str) -> np.ndarray:
    """The characters that n-grams are taken from: lower case, each run of other ASCII characters than letters one space,
    and a space at both ends. Without digits and punctuation the model finds more (84 of 97 held-out rows, 78 with them)."""
    a = np.concatenate([[np.uint32(32)], code_points(text.lower()), [np.uint32(32)]])
    ascii_ = a < 128
    a[ascii_] = _LETTERS[a[ascii_]]
    kept = np.ones(len(a), bool)
    kept[1:] = (a[1:] != 32) | (a[:-1] != 32)
    return a[kept]


def features() -> Callable[[str], np.ndarray]:
    """A function from a whole text to the distinct buckets of its character n-grams."""
    distinct = Distinct()

    def of(text: str) -> np.ndarray:
        parts: list[np.ndarray] = []
        for found in char_buckets(plain(text), ORDERS):
            parts.append(found)
            if len(parts) == 16:  # very long texts: distinct buckets are bounded, n-grams aren't
                parts = [distinct(parts)]
        return distinct(parts)

    return of


def train(docs: DataFrame, labels: DataFrame, rows: dict[int, int] = TRAINING_ROWS) -> Model:
    """A model from at most ``rows[c]`` rows labelled c, weighted to their ratio in the table, none of them held out."""

    def learn(found: Rows, y: np.ndarray, times: np.ndarray, held_out: np.ndarray) -> Model:
        return fit(found, y, log_count_ratio=True, rate=1.0, even=0.5, times=times)

    return fitted(labelled_sample(docs, labels, "toxic", features, rows), learn)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, from the whole text alone.

    A null text is scored as an empty one. A null id stays null and isn't held out. Repeated rows each give a row, and
    an empty table none. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = features(), sent.value
        for batch in batches:
            p = [own.probability(of(x.as_py())) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    rows = documents(docs, id_col, text_col).select("doc_id", held, "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text the model doesn't predict to be toxic.

    Null texts count as empty; ids aren't read. Repeated rows stay or go alike. Columns may have any name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = features(), sent.value
        for batch in batches:
            yield batch.filter(pa.array([own.probability(of(x.as_py() or "")) < 0.5 for x in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
