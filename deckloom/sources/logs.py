"""Readers and writers of run logs, ledgers, sessions and project manifests."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.schemas import LEDGER, PROJECT, RUN, TURN

LINES = 2000
#: Folders of sessions, for all writers of a path.
SESSION_FOLDERS = 256
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON record a line; blank lines vanish and lines that aren't records are passed over. Folders are read with all inside."""
    rows = spark.read.schema(f"{schema}, __corrupt string").option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
    rows = rows.option("columnNameOfCorruptRecord", "__corrupt").json(path)
    return rows.filter("__corrupt is null").drop("__corrupt")


def last_lines(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """``value, file, block, line``: the last ``limit`` lines of a log, which is a file or a folder of files that are older the
    smaller their paths; blank and broken lines count. The last three columns are a line's place.

    Files are listed without being read; then the newest are read, four times as many each time, until they hold enough
    lines. Older ones are never opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    count = 1
    while True:
        newest = [r.path for r in files.orderBy(F.desc("path")).limit(count).collect()]
        lines = spark.read.text(newest) if newest else spark.createDataFrame([], "value string, _metadata struct<file_path: string, file_block_start: bigint>")
        if len(newest) < count or lines.select("value").limit(limit).count() >= limit:
            break
        count *= 4
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    return lines.select("value", *place).orderBy(F.desc("file"), F.desc("block"), F.desc("line")).limit(limit)


def read_runs(spark: SparkSession, path: str, limit: int | None = LINES) -> DataFrame:
    """SRC-1: the runs on the last ``limit`` lines of the log, oldest first; all if None.

    Blank lines and lines that aren't records are among the lines that are counted, and then passed over.
    """
    if limit is None:
        return read_lines(spark, path, RUN).orderBy("started_at", "run_id")
    lines = last_lines(spark, path, limit)
    record = F.from_json("value", f"{RUN}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    rows = lines.filter(F.trim("value") != "").withColumn("r", record).filter("r.__corrupt is null")
    return rows.orderBy("file", "block", "line").select("r.*").drop("__corrupt")


def read_ledger(spark: SparkSession, path: str, limit: int | None = LINES) -> DataFrame:
    """SRC-2: the newest ``limit`` entries of each project, in order; all if None."""
    rows = read_lines(spark, path, LEDGER)
    if limit is not None:
        newest = Window.partitionBy("project_id").orderBy(F.desc("seq"))
        rows = rows.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= limit).drop("__r")
    return rows


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: the turns."""
    return read_lines(spark, path, TURN)


def compactions(turns: DataFrame) -> DataFrame:
    """SRC-3: ``project_id, compacted``, the number of summary turns."""
    return turns.groupBy("project_id").agg(F.count(F.when(F.col("speaker") == "summary", 1)).alias("compacted"))


def read_projects(spark: SparkSession, root: str, name: str = "project.json") -> DataFrame:
    """Manifests ``root/*/name``, one file for each project, or a pattern for their names. An id that is missing is the name of its
    folder (``key=value``, as Spark's own writers call folders, is called value); corrupt files are passed over."""
    rows = spark.read.schema(f"{PROJECT}, __corrupt string").option("multiLine", True)
    rows = rows.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__corrupt").json(f"{root}/*/{name}")
    folder = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "^[^=]*=", "")
    rows = rows.withColumn("__folder", folder).filter("__corrupt is null")
    return rows.withColumn("project_id", F.coalesce("project_id", "__folder")).drop("__corrupt", "__folder")


def pack_projects(manifests: DataFrame, path: str) -> None:
    """Write manifests ``folder, manifest`` many to a file: a file and a folder for each project cost more than their bytes."""
    manifests.select("folder", "manifest").write.parquet(path)


def read_packed_projects(spark: SparkSession, path: str) -> DataFrame:
    """The projects of packed manifests, by the rules of ``read_projects``: an id that is missing is the name of the folder, and
    manifests that aren't records are passed over."""
    record = F.from_json("manifest", f"{PROJECT}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    rows = spark.read.schema("folder string, manifest string").parquet(path).select("folder", record.alias("r")).filter("r IS NOT NULL AND r.__corrupt IS NULL")
    rows = rows.select("folder", "r.*").drop("__corrupt")
    return rows.withColumn("project_id", F.coalesce("project_id", "folder")).drop("folder")


def project_catalog(projects: DataFrame) -> DataFrame:
    """SRC-4: ``project_id, status, title, file, updated_at, duration, output`` of each project, newest first."""
    seconds = F.aggregate(F.coalesce("scenes", F.array()), F.lit(0.0), lambda t, s: t + F.coalesce(s["duration"], F.lit(0.0)))
    rows = projects.select(
        "project_id",
        "status",
        F.col("document.title").alias("title"),
        F.col("source.file").alias("file"),
        "updated_at",
        F.round(seconds, 1).alias("duration"),
        F.col("render.output_path").alias("output"),
    )
    return rows.orderBy(F.desc(F.coalesce("updated_at", F.lit(""))), "project_id")


def shred_projects(projects: DataFrame) -> dict[str, DataFrame]:
    """SRC-5: one table for each entity; every row has ``project_id`` and its place in the list it came from, from 1."""

    def opened(df: DataFrame, keys: list[str | Column], column: str, place: str) -> DataFrame:
        rows = df.select(*keys, F.posexplode(column).alias("__i", "__x"))
        return rows.select(*[c for c in rows.columns if c[:2] != "__"], (F.col("__i") + 1).alias(place), "__x.*")

    pages = opened(projects, ["project_id"], "document.pages", "page_seq")
    elements = opened(pages, ["project_id", "page_index"], "elements", "seq")
    scenes = opened(projects, ["project_id"], "scenes", "scene_seq")
    return {
        "pages": pages.drop("elements"),
        "elements": elements,
        "scenes": scenes.drop("segments", "actions"),
        "segments": opened(scenes, ["project_id", "scene_id"], "segments", "seg_seq"),
        "actions": opened(scenes, ["project_id", "scene_id"], "actions", "action_seq"),
    }


def admission(files: DataFrame, max_mb: int = 100) -> DataFrame:
    """SRC-6: ``type`` and ``reason`` of files told by ``path`` and ``length``; a null reason is admitted."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin("pdf", "ppt", "pptx"), suffix)
    reason = F.when(kind.isNull(), "unsupported type").when(F.col("length") > max_mb * 1024 * 1024, "too large")
    return files.select("path", "length", kind.alias("type"), reason.alias("reason"))


def admit_sources(spark: SparkSession, folder: str, max_mb: int = 100) -> DataFrame:
    """SRC-6: ``path, length, type, reason`` of each file under a folder; only names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return admission(files, max_mb)


def readable_name(name: Column) -> Column:
    """SRC-7: decode a percent-encoded name; it stays as it is if it has no escape or doesn't decode to UTF-8."""
    plus_kept = F.regexp_replace(name, r"\+", "%2B")
    decoded = F.try_url_decode(plus_kept)
    broken = decoded.isNull() | decoded.contains("�") | ~name.rlike("%[0-9A-Fa-f]{2}")
    return F.when(broken, name).otherwise(decoded)


def deck_from_text(docs: DataFrame, lines_per_page: int = 8) -> DataFrame:
    """SRC-8: ``doc_id, page_index, seq, text``: lines that aren't empty, a fixed number of them to a page, from 1."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    rows = docs.select("doc_id", F.posexplode(lines).alias("i", "text"))
    page = (F.floor(F.col("i") / lines_per_page) + 1).cast("int").alias("page_index")
    return rows.select("doc_id", page, (F.col("i") % lines_per_page + 1).cast("int").alias("seq"), "text")


def append_log(df: DataFrame, path: str) -> bool:
    """SNK-1: add records to a JSON-lines log. A failing write is logged and never reaches the caller; returns if it went well."""
    try:
        df.write.mode("append").option("timestampFormat", MICROS).option("timestampNTZFormat", MICROS.removesuffix("XXX")).json(path)
    except Exception:  # whatever the log's store does, the job that writes to it goes on
        logging.getLogger(__name__).warning("could not append to %s", path, exc_info=True)
        return False
    return True


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """SNK-1: add the records of a stream to a JSON-lines log, all that the source holds now.

    Each batch is a folder of the log by its number. A batch that is retried, after a failure or a restart from the
    checkpoint, writes over its own folder, so no record is ever there twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        folder = f"{path.rstrip('/')}/batch-{number:012d}"
        batch.write.mode("overwrite").option("timestampFormat", MICROS).option("timestampNTZFormat", MICROS.removesuffix("XXX")).json(folder)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def session_folder(project_id: Column) -> Column:
    """The number of the folder that holds a project's session: a reader of one session filters ``folder`` by it."""
    return F.pmod(F.xxhash64(project_id), F.lit(SESSION_FOLDERS)).cast("int")


def overwrite_turns(turns: DataFrame, path: str) -> None:
    """SNK-2: replace the sessions of the projects in ``turns``; other projects' sessions stay.

    Sessions share folders by a hash of their project, in order inside a file: a folder and a file for each project cost more than
    their bytes. Folders with a session that is replaced are written anew, the others aren't opened.
    """
    spark, new = turns.sparkSession, turns.withColumn("folder", session_folder(F.col("project_id")))
    touched = [r.folder for r in new.select("folder").distinct().collect()]
    new.limit(0).write.mode("append").partitionBy("folder").parquet(path)  # so that there is a folder to read
    old = spark.read.schema(new.schema).parquet(path).filter(F.col("folder").isin(touched))
    rows = new.withColumn("__new", F.lit(1)).unionByName(old.withColumn("__new", F.lit(0))).repartition("folder")
    newest = F.max("__new").over(Window.partitionBy("folder", "project_id"))
    rows = rows.withColumn("__newest", newest).filter(F.col("__new") == F.col("__newest")).drop("__new", "__newest")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)


def assign_seq(new: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """SNK-3: number new entries of each project on from the largest stored ``seq``, in the given order."""
    last = existing.groupBy("project_id").agg(F.max("seq").alias("__last"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(*order))
    rows = new.withColumn("__place", place).join(last, "project_id", "left")
    return rows.withColumn("seq", (F.coalesce("__last", F.lit(0)) + F.col("__place")).cast("long")).drop("__place", "__last")
