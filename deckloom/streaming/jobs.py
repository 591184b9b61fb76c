"""Job state and run counters kept current from streams.

A stream's state lives in two places. The query keeps what it needs to go on, a small record for each job that isn't over;
what readers see is a table of versions, one for each batch, which a retried batch writes over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from deckloom.operators.order_statistics import distribution
from deckloom.sources.shared import shared_path
from deckloom.sources.versions import Versions, newest_by

TERMINAL = ("succeeded", "failed", "cancelled")
#: A job's state is dropped when the watermark is this far past its last event; its outcome stays in the table.
KEEP = "1 day"
#: Events that come later than this after newer ones are passed over.
DELAY = "1 hour"
#: Batches after which versions are folded into a snapshot.
FOLD_EVERY = 16

JOB = "job_id string, status string, stage string, done int, total int, updated_at timestamp, event_id bigint"
#: A job in the query's state: its event, and the newest time that any of its events had.
KEPT = "job_id string, status string, stage string, done int, total int, micros bigint, event_id bigint, last bigint"
FIELDS = [x.split()[0] for x in KEPT.split(", ")]
#: Jobs are kept in this many groups by a hash: a call to the store takes about a millisecond, so it is made for a group and not for a
#: job. A stream that goes on from a checkpoint needs the same number.
GROUPS = 512
COUNTS = "kind string, name string, value double, n bigint, failed bigint"


def job_state(events: DataFrame) -> DataFrame:
    """STR-1 on a batch: ``job_id, status, stage, done, total, updated_at``: each job's latest state.

    The first terminal status of a job sticks: later events don't change it. Ties in time go to the larger event id.
    """
    ended = F.col("status").isin(*TERMINAL)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    order = F.struct(ended.cast("int").alias("e"), F.when(ended, -micros).otherwise(micros).alias("t"), F.when(ended, -F.col("event_id")).otherwise(F.col("event_id")).alias("i"))
    state = F.max_by(F.struct("status", "stage", "done", "total", F.col("ts").alias("updated_at")), order)
    return events.groupBy("job_id").agg(state.alias("s")).select("job_id", "s.*")


def latest_of(events: pd.DataFrame) -> pd.DataFrame:
    """Of each job its latest event, or its first terminal one, with the newest time of all in ``last``."""
    ended = events["status"].isin(TERMINAL).to_numpy()
    sign = np.where(ended, 1, -1)
    order = np.lexsort((sign * events["event_id"].to_numpy(), sign * events["micros"].to_numpy(), ~ended))
    first = events.iloc[order].drop_duplicates("job_id")
    return first.assign(last=first["job_id"].map(events.groupby("job_id")["last"].max()))


class JobStates(StatefulProcessor):
    """The states of a group of jobs: of each its latest event, or its first terminal one, which no later event changes.

    A timer goes off when the watermark is ``keep_ms`` past the last event of one of the jobs, and drops those of which that is
    true. An event after that is a new start.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("jobs", f"jobs array<struct<{KEPT.replace(' ', ':').replace(',:', ',')}>>")

    def _jobs(self) -> list[tuple]:
        found = self.state.get()
        return [tuple(x) for x in found[0]] if found else []

    def _keep(self, jobs: list[tuple]) -> None:
        """Store the jobs, and set the group's one timer to when the first of them ends."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if jobs:
            self.state.update((jobs,))
            self.handle.registerTimer(min(x[-1] for x in jobs) // 1000 + self.keep_ms)
        else:
            self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self._jobs()
        jobs = pd.DataFrame(old, columns=FIELDS)
        for events in rows:
            events = events.assign(last=events["micros"])[FIELDS]
            jobs = latest_of(pd.concat([jobs, events]) if len(jobs) else events)
        jobs = jobs.astype({"done": "Int64", "total": "Int64"})
        plain = jobs.astype(object)
        self._keep(list(plain.where(plain.notna(), None).itertuples(index=False, name=None)))
        before = {x[0]: x[6] for x in old}
        changed = [before.get(job) != number for job, number in zip(jobs["job_id"], jobs["event_id"], strict=True)]
        if any(changed):
            yield jobs[changed].drop(columns="last")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() - self.keep_ms
        self._keep([x for x in self._jobs() if x[-1] // 1000 > passed])
        return iter(())

    def close(self) -> None:
        pass


def job_updates(events: DataFrame, keep: str = KEEP, delay: str = DELAY) -> DataFrame:
    """STR-1 on a stream: the state of each job that a batch changes, in update mode. Events have ``job_id, event_id, ts`` and so on."""
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    group = F.pmod(F.xxhash64("job_id"), F.lit(GROUPS)).cast("int").alias("jobs")
    rows = events.select(group, "job_id", F.col("event_id").cast("bigint").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "status", "stage", F.col("done").cast("int").alias("done"), F.col("total").cast("int").alias("total"))
    rows = rows.withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))
    states = rows.groupBy("jobs").transformWithStateInPandas(JobStates(keep_ms), outputStructType=KEPT.removesuffix(", last bigint"), outputMode="Update", timeMode="EventTime")
    return states.select("job_id", "status", "stage", "done", "total", F.timestamp_micros("micros").alias("updated_at"), "event_id")


def job_table(spark: SparkSession, path: str) -> Versions:
    return Versions(spark, path, JOB)


def known_jobs(table: Versions) -> DataFrame:
    """What a late subscriber reads: the last state of every job, over or not, expired or not."""
    return newest_by(table.rows(), "job_id").drop("event_id")


def followed(stream: DataFrame, table: Versions, merge: Callable[[DataFrame], DataFrame], delta: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Run a stream over all that its source holds now; each batch's ``delta`` is a version of the table.

    The stream goes on from the checkpoint. A batch that is retried after a failure writes over its own version.
    """

    def put(batch: DataFrame, number: int) -> None:
        table.put(delta(batch), number)
        if number % FOLD_EVERY == FOLD_EVERY - 1:
            table.fold(merge, number - 1)  # the batch itself may yet be retried with other rows

    spark = stream.sparkSession
    store, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    query.awaitTermination()


def follow_jobs(events: DataFrame, table: Versions, checkpoint: str, keep: str = KEEP, delay: str = DELAY) -> None:
    """STR-1: keep a table of job states current from a stream of events."""
    followed(job_updates(events, keep, delay), table, lambda rows: newest_by(rows, "job_id"), lambda batch: batch, checkpoint)


def run_counts(runs: DataFrame) -> DataFrame:
    """STR-2: ``kind, name, value, n, failed``: runs by status, stages by duration, degradations by what they are.

    Counts of one set of runs and of another add up to those of both.
    """
    of = lambda kind, name, value, failed: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"), failed.cast("bigint").alias("failed"))
    none = F.lit(None)
    one = F.explode(F.concat(
        F.array(of("run", F.col("status"), none, F.lit(0))),
        F.transform(F.coalesce("stages", F.array()), lambda s: of("stage", s["stage"], s["duration_s"], (s["status"] == "failed").cast("int"))),
        F.transform(F.coalesce("degradations", F.array()), lambda d: of("degradation", d["what"], none, F.lit(0))),
    ))
    return runs.select(one.alias("x")).select("x.*").groupBy("kind", "name", "value").agg(F.count("*").alias("n"), F.sum(F.coalesce("failed", F.lit(0))).alias("failed"))


def merged_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "name", "value").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))


def count_table(spark: SparkSession, path: str) -> Versions:
    return Versions(spark, path, COUNTS)


def follow_runs(runs: DataFrame, table: Versions, checkpoint: str) -> None:
    """STR-2: keep a table of counts current from a stream of runs; exact however often a batch is retried."""
    followed(runs, table, merged_counts, run_counts, checkpoint)


def totals(counts: DataFrame) -> DataFrame:
    """RUN-1 from counts: ``runs, succeeded, failed``."""
    n = lambda *status: F.coalesce(F.sum(F.when((F.col("kind") == "run") & (F.col("name").isin(*status) if status else F.lit(True)), F.col("n"))), F.lit(0))
    return counts.agg(n().alias("runs"), n("succeeded").alias("succeeded"), n("failed").alias("failed"))


def degradations(counts: DataFrame) -> DataFrame:
    """RUN-5 from counts: ``what, count``, most frequent first."""
    rows = counts.filter("kind = 'degradation'").groupBy(F.col("name").alias("what")).agg(F.sum("n").alias("n"))
    return rows.orderBy(F.desc("n"), "what")


def stage_summary(counts: DataFrame) -> DataFrame:
    """RUN-4 from counts: ``stage, count, median, p95, failed``, exact; the runs themselves aren't read.

    Equal durations, which are counted together, are set apart again inside each task for the selection of ranks.
    """
    stages = counts.filter("kind = 'stage'").select(F.col("name").alias("stage"), "value", "n", "failed")
    failed = stages.groupBy("stage").agg(F.sum("failed").alias("failed"))
    apart = stages.filter("value IS NOT NULL").select("stage", F.explode(F.array_repeat("value", F.col("n").cast("int"))).alias("duration_s"))
    return distribution(apart, ["stage"], "duration_s", 0.95, "p95", 3).join(failed, "stage")


def list_jobs(jobs: DataFrame, n: int = 50) -> DataFrame:
    """STR-3: the newest jobs."""
    return jobs.orderBy(F.desc("updated_at"), "job_id").limit(n)


def as_stream(df: DataFrame, name: str, slices: list[DataFrame] | None = None) -> DataFrame:
    """Rows written as files in the shared folder and read back as a stream of a few files at a time.

    Slices, if given, are written one after the other, and the stream reads them in that order.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    for part in slices or [df]:
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


def time_slices(df: DataFrame, column: str, count: int = 3) -> list[DataFrame]:
    """The rows in parts that follow each other in time."""
    at = F.col(column)
    bounds = df.select(F.percentile_approx(at.cast("timestamp").cast("double"), [k / count for k in range(1, count)])).first()[0] or []
    marks = [None, *sorted(set(bounds)), None]
    seconds = at.cast("timestamp").cast("double")
    parts = []
    for low, high in zip(marks, marks[1:]):
        tests = [seconds >= low] * (low is not None) + [seconds < high] * (high is not None)
        parts.append(df.filter(reduce(lambda a, b: a & b, tests, F.lit(True))))
    return parts
