"""New paths and tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING: dict = {"lock": threading.Lock(), "users": 0, "before": None}


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that ``spark.checkpoint.dir`` names.

    Without that setting a session whose executors are threads of the driver (``local[...]``, as in tests) gets a
    temporary folder; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="deckloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffle_files_cleaned(spark: SparkSession) -> Iterator[None]:
    """Spark deletes an execution's shuffle files at its end. Writers at the same time share one change of the setting."""
    with _CLEANING["lock"]:
        if not _CLEANING["users"]:
            _CLEANING["before"] = spark.conf.get(_CLEAN_UP, None)
            spark.conf.set(_CLEAN_UP, "true")
        _CLEANING["users"] += 1
    try:
        yield
    finally:
        with _CLEANING["lock"]:
            _CLEANING["users"] -= 1
            if not _CLEANING["users"] and _CLEANING["before"] is None:
                spark.conf.unset(_CLEAN_UP)
            elif not _CLEANING["users"]:
                spark.conf.set(_CLEAN_UP, _CLEANING["before"])


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: works it out once, cuts lineage and survives lost executors.

    A path given is written over. The shuffle files behind the rows are of no use once they are written, so Spark is
    asked to delete them with the job.
    """
    spark, path = df.sparkSession, path or shared_path(df.sparkSession, name)
    with _shuffle_files_cleaned(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
