"""The training-data pipeline: each stage works on all that the stage before kept.

``run`` applies the stages to ``documents``; between stages the rows are written to the shared folder and read back, so
a lost executor costs a stage's tasks and not the whole run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deckloom.llm import mixing, packing, simhash, substrings, toxicity
from deckloom.llm.common import fresh, stored, table

#: The toxicity model and SimHash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go.

    Null texts count as empty, and repeated rows go or stay alike. Without labels of both kinds nothing goes but what the
    labels' one kind says; without any, or without documents, nothing goes.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Null, empty and blank texts are one group. Rows with a null id stay; of rows with one id, one stays. An empty table
    stays empty.
    """
    return simhash.first_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word sequences that an earlier document or place has are cut out of the texts; ``n_chars`` is their new length.

    Every row stays, with an empty text if no word is left; a null text stays null. Rows equal in id and text are one
    document, cut alike. An empty table stays empty.
    """
    return substrings.remove_repeats(docs, chars_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, by their source's target rate, and are shuffled.

    A null source is a source of its own; rows with equal ids repeat alike. An empty table stays empty.
    """
    copy, key = fresh(docs, "__copy", "__shuffle_key")
    mixed = mixing.mix(docs, mixing.size_tempered(docs), copy_col=copy, key_col=key)
    return mixed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the copies, laid out in windows: one row for each piece.

    Every row is a document of its own, whatever its id; a null or empty text has the end id alone. An empty table gives
    no pieces.
    """
    import public_tokenizers

    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
