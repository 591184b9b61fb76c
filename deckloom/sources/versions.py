"""Tables that grow by numbered versions: each version is written whole, and again over itself if it is retried.

The number is a batch's of a stream, or a run's. Versions are folded into a snapshot from time to time, so that readers merge few of
them; a version that is retried after it was folded changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Versions:
    """``rows()`` are the rows of the newest snapshot and of all versions after it, with their number in ``version``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        none = spark.createDataFrame([], schema)
        for kind in ("versions", "snapshots"):
            none.write.mode("ignore").parquet(f"{self.path}/{kind}/version=-1")

    def put(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, version bigint").parquet(f"{self.path}/{kind}")

    def _folded(self) -> int:
        """The number of the newest snapshot, from the names of the folders."""
        newest = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.path}/snapshots")
        number = F.regexp_extract("path", r"version=(-?[0-9]+)/[^/]*$", 1)
        return int(newest.select(F.max(number.cast("bigint"))).first()[0])

    def rows(self) -> DataFrame:
        upto = self._folded()
        return self._read("snapshots").filter(F.col("version") == upto).unionByName(self._read("versions").filter(F.col("version") > upto))

    def fold(self, merge: Callable[[DataFrame], DataFrame], upto: int) -> None:
        """Put ``merge`` of all rows up to a version into a snapshot."""
        if upto > self._folded():
            merge(self.rows().filter(F.col("version") <= upto)).write.mode("overwrite").parquet(f"{self.path}/snapshots/version={upto}")


def last_of(rows: DataFrame, *keys: str) -> DataFrame:
    """All rows of the newest version that each key has, with their number."""
    return rows.withColumn("__newest", F.max("version").over(Window.partitionBy(*keys))).filter(F.col("version") == F.col("__newest")).drop("__newest")


def newest_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows with equal keys, the one of the newest version, without its number."""
    others = [c for c in rows.columns if c not in (*keys, "version")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("__x")).select(*keys, *[F.col("__x")[c].alias(c) for c in others])
