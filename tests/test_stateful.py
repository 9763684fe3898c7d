"""Streams with state against their batch rules, over several batches."""

import pytest
from pyspark.sql import functions as F

from marginalia.sources.tables import table
from marginalia.streaming import jobs as J
from marginalia.streaming import stateful as S


@pytest.fixture(autouse=True)
def few_stores(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def stream_of(spark, df, path, files, order):
    """A stream that takes one file at a time, rows in order."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


@pytest.mark.parametrize("files", [1, 3])
def test_sessions_close_by_timers(spark, sf_dir, tmp_path, files):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).filter("user_id < 12")
    stream = stream_of(spark, events, tmp_path, files, "ts")
    got = S.last_sessions(S.run_once(S.session_rows(stream, 21_600), "test"))
    want = J.heartbeat_sessions(events, 21_600).select("user_id", "started", "n_events", "ended")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_repeats_are_dropped(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).limit(200)
    again = events.unionByName(events.filter("event_id % 3 = 0")).unionByName(events.filter("event_id % 9 = 0"))
    got = S.run_once(S.without_repeats(stream_of(spark, again, tmp_path, 3, "ts")), "test")
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in events.collect())


def test_jobs_end_by_an_event_or_by_a_timer(spark, tmp_path):
    minute = 60
    events = [(1, 0, "reading", 0.1), (1, 2, "analyzing", 0.5), (1, 3, "done", 1.0), (1, 4, "reading", 0.0), (2, 0, "reading", 0.2), (3, 1, "reading", 0.3), (3, 9, "done", 1.0), (4, 38, "reading", 0.4), (5, 40, "queued", 0.0)]
    df = spark.createDataFrame([(j, (60 + a) * minute, s, p) for j, a, s, p in events], "job_id long, at long, status string, progress double").select("job_id", F.timestamp_seconds("at").alias("ts"), "status", "progress")
    got = S.last_jobs(S.run_once(S.job_rows(stream_of(spark, df, tmp_path, 3, "ts"), 150, "1 second"), "test")).collect()
    assert {r["job_id"]: (r["status"], r["progress"]) for r in got} == {1: ("done", 1.0), 2: ("cancelled", 0.2), 3: ("cancelled", 0.3), 4: ("reading", 0.4), 5: ("queued", 0.0)}
