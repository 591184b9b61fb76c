"""Streams over several batches: states that end and expire, retried batches, folded versions."""

from datetime import datetime, timedelta

import pytest
from deckloom.operators import runs as run_operators
from deckloom.sources import logs
from deckloom.sources.versions import Versions, newest_by
from deckloom.streaming import jobs
from pyspark.sql import functions as F

EVENT = "job_id string, event_id long, ts timestamp, status string, stage string, done int, total int"
START = datetime(2024, 1, 1)


def event(job, number, minutes, status="running"):
    return job, number, START + timedelta(minutes=minutes), status, f"stage{number}", number, 100


@pytest.fixture
def feed(spark, tmp_path):
    """A source folder, and a function that adds a batch's rows to it as one file and runs the stream over what is new."""
    table = jobs.job_table(spark, str(tmp_path / "table"))

    def add(rows):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
        jobs.follow_jobs(stream, table, str(tmp_path / "checkpoint"), keep="60 minutes", delay="0 minutes")
        return {r.job_id: (r.status, r.done) for r in jobs.known_jobs(table).collect()}

    return add


def test_a_terminal_status_stays_and_an_expired_job_begins_anew(feed):
    assert feed([event("a", 1, 0), event("b", 2, 1), event("a", 3, 2)]) == {"a": ("running", 3), "b": ("running", 2)}
    assert feed([event("a", 4, 3, "failed"), event("a", 5, 4), event("b", 6, 5)]) == {"a": ("failed", 4), "b": ("running", 6)}
    # neither a later event nor a later terminal one changes the outcome
    assert feed([event("a", 7, 6), event("a", 8, 7, "succeeded"), event("c", 9, 7)])["a"] == ("failed", 4)
    # the watermark passes a's last event by more than an hour: its state goes, its outcome stays in the table
    assert feed([event("c", 10, 90)]) == {"a": ("failed", 4), "b": ("running", 6), "c": ("running", 10)}
    assert feed([event("c", 11, 95)])["a"] == ("failed", 4)
    # so an event after that is a new start, while c, whose state lives on, keeps its order
    assert feed([event("a", 12, 200), event("c", 13, 96, "succeeded")]) == {"a": ("running", 12), "b": ("running", 6), "c": ("succeeded", 13)}


def test_jobs_of_one_group_end_and_expire_each_on_its_own(feed, monkeypatch):
    monkeypatch.setattr(jobs, "GROUPS", 1)
    test_a_terminal_status_stays_and_an_expired_job_begins_anew(feed)


def test_the_store_is_called_for_groups_not_for_jobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "GROUPS", 3)
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [event(f"j{k}", k, k % 5) for k in range(100)] + [("j7", 200, START, "failed", None, None, None)]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / "events"))
    updates = jobs.job_updates(spark.readStream.schema(EVENT).parquet(str(tmp_path / "events")))
    query = updates.writeStream.outputMode("update").format("memory").queryName("grouped").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.conf.unset(provider)
    got = {r.job_id: (r.status, r.done, r.event_id, r.updated_at) for r in spark.table("grouped").collect()}
    assert len(got) == 100 and got["j9"][:3] == ("running", 9, 9) and got["j7"] == ("failed", None, 200, START)
    assert query.recentProgress[0].stateOperators[0].customMetrics["numRegisteredTimers"] <= 3


def run(number, status="succeeded"):
    stages = [("parse", float(number % 5), "done", None), ("render", float(number), "failed" if number % 4 == 0 else "done", None)]
    return f"r{number}", status, stages, [("voice", "x")] * (number % 3 == 0)


def forget_commit(tmp_path, number):
    """As if the query had died before it noted that batch."""
    for name in (f"{number}", f".{number}.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()


RUN = "run_id string, status string, stages array<struct<stage string, duration_s double, status string, detail string>>, degradations array<struct<what string, reason string>>"


def test_counts_of_a_stream_are_those_of_the_runs_however_often_batches_are_retried(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "FOLD_EVERY", 2)
    table = jobs.count_table(spark, str(tmp_path / "table"))
    all_runs = spark.createDataFrame([run(k, "failed" if k % 7 == 0 else "succeeded") for k in range(1, 61)], RUN)

    def follow():
        stream = spark.readStream.schema(RUN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "runs"))
        jobs.follow_runs(stream, table, str(tmp_path / "checkpoint"))
        return jobs.merged_counts(table.rows())

    def same(counts, rows):
        assert jobs.totals(counts).first() == run_operators.run_counts(rows).first()
        assert sorted(jobs.stage_summary(counts).collect()) == sorted(run_operators.stage_summary(rows).select("stage", "count", "median", "p95", "failed").collect())
        assert jobs.degradations(counts).collect() == run_operators.degradation_counts(rows).collect()

    for k in range(5):
        all_runs.filter(f"int(substr(run_id, 2)) % 5 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))
    same(follow(), all_runs)
    before = sorted(map(str, table.rows().drop("version").collect()))
    forget_commit(tmp_path, 4)
    same(follow(), all_runs)
    assert sorted(map(str, table.rows().drop("version").collect())) == before
    table.put(jobs.run_counts(all_runs), 1)  # a version that is folded already is retried
    same(jobs.merged_counts(table.rows()), all_runs)


def test_versions_fold_and_the_newest_row_of_a_key_counts(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), "k string, x int")
    assert table.rows().count() == 0
    for number in range(4):
        table.put(spark.createDataFrame([("a", number), (f"only{number}", number)], "k string, x int"), number)
    want = {"a": 3, **{f"only{n}": n for n in range(4)}}
    assert {r.k: r.x for r in newest_by(table.rows(), "k").collect()} == want
    table.fold(lambda rows: newest_by(rows, "k"), 2)
    assert table.rows().count() == 4 + 2 and {r.k: r.x for r in newest_by(table.rows(), "k").collect()} == want


def test_a_streamed_log_has_each_record_once(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("p%d", F.col("id") % 3).alias("project_id"), F.col("id").alias("seq"), F.lit("stage").alias("kind"), F.lit("x").alias("name"))

    def follow():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "source"))
        logs.append_stream(stream, str(tmp_path / "log"), str(tmp_path / "checkpoint"))
        return sorted(r.seq for r in logs.read_ledger(spark, str(tmp_path / "log"), None).collect())

    for k in range(3):
        rows.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "source"))
        assert follow() == [i for i in range(40) if i % 3 <= k]
    forget_commit(tmp_path, 2)
    assert follow() == list(range(40))
