"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.sources.shared import shared_path, stored

__all__ = ["PIECE_BYTES", "WORD", "bytes_of", "documents", "fresh", "pieces", "shared_path", "stored", "table"]

#: A regular expression for a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handed to the word loops in pieces of about this many bytes.
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores behind it as it takes to be none of the DataFrame's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id (long) and the whole text (null: empty), so other columns of any name never clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, without decoding it; null is empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def pieces(text: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """Cut a long text before white space, so that loops over its words hold a bounded number of them."""
    at = 0
    while len(text) - at > limit:
        cut = _SPACE.search(text, at + limit)
        if cut is None:
            break
        end = cut.start()
        yield text[at:end]
        at = end
    yield text[at:]
