"""Sessions and jobs of a stream with event-time timers, and a stream without repeated deliveries.

A session or job is one small value for its key, whatever the number of events, in a state store with column families, which stateful() sets for what is started inside it.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marginalia.sources.shared import shared_dir
from marginalia.streaming.jobs import ABANDON_S, FINAL

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB = "job_id long, status string, progress double, last_seen long"
SESSION = "user_id long, n_events long, started long, ended long"


@contextlib.contextmanager
def stateful(spark: SparkSession):
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_once(stream: DataFrame, kind: str) -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder; the checkpoint lies beside it."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/marginalia-{kind}-{uuid.uuid4().hex}"
    with stateful(spark):
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


class Sessions(StatefulProcessor):
    """A user's runs of events at most gap_s apart. Every batch tells the open session as far as it is; a timer closes it when the watermark has passed its end by the gap."""

    def __init__(self, gap_s: int):
        self.gap = gap_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "n_events long, started long, ended long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, started, ended = self.open.get() if self.open.exists() else (0, None, None)
        out = []
        for at in sorted(at for pdf in rows for at in pdf["at"]):
            if n and at - ended > self.gap:
                out.append((key[0], n, started, ended))
                n = 0
            n, started, ended = n + 1, at if not n else min(started, at), at if not n else max(ended, at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.open.update((n, started, ended))
        self.handle.registerTimer((ended + self.gap) // 1000 + 1)
        yield pd.DataFrame([*out, (key[0], n, started, ended)], columns=["user_id", "n_events", "started", "ended"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        yield pd.DataFrame(columns=["user_id", "n_events", "started", "ended"])

    def close(self) -> None:
        pass


def session_rows(events: DataFrame, gap_s: int, late: str = "10 minutes") -> DataFrame:
    """SESSION rows of a stream of events (user_id, ts TIMESTAMP): each session as often as it grew, the longest last."""
    timed = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("at"))
    return timed.groupBy("user_id").transformWithStateInPandas(Sessions(gap_s), SESSION, "Append", "EventTime")


def last_sessions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "started").agg(F.max("n_events").alias("n_events"), F.max("ended").alias("ended"))


class Jobs(StatefulProcessor):
    """The state of a job: the last status before a final one holds on, progress never falls. A job without a sign for idle_s is cancelled, by a timer once the watermark
    has passed, or by the event that comes later than that."""

    def __init__(self, idle_s: int):
        self.idle = idle_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", "status string, progress double, last_seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, progress, seen = self.state.get() if self.state.exists() else ("queued", 0.0, None)
        for at, new, done in sorted((x for pdf in rows for x in zip(pdf["at"], pdf["status"], pdf["progress"])), key=lambda x: x[0]):
            if seen is not None and status not in FINAL and at - seen > self.idle:
                status = "cancelled"
            if status not in FINAL:
                status, progress, seen = new, min(1.0, max(progress, float(done))), int(at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((status, progress, seen))
        if status not in FINAL:
            self.handle.registerTimer((seen + self.idle) // 1000 + 1)
        yield pd.DataFrame([(key[0], status, progress, seen)], columns=["job_id", "status", "progress", "last_seen"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, progress, seen = self.state.get()
        self.state.update(("cancelled", progress, seen))
        yield pd.DataFrame([(key[0], "cancelled", progress, seen)], columns=["job_id", "status", "progress", "last_seen"])

    def close(self) -> None:
        pass


def job_rows(job_events: DataFrame, idle_s: int = ABANDON_S, late: str = "10 minutes") -> DataFrame:
    """JOB rows of a stream of events (job_id, ts TIMESTAMP, status, progress), one for each change."""
    timed = job_events.withWatermark("ts", late).select("job_id", "ts", F.unix_micros("ts").alias("at"), "status", "progress")
    return timed.groupBy("job_id").transformWithStateInPandas(Jobs(idle_s), JOB, "Append", "EventTime")


def last_jobs(rows: DataFrame) -> DataFrame:
    place = F.struct(F.col("status").isin(*FINAL), "last_seen", "progress")
    return rows.groupBy("job_id").agg(F.max_by("status", place).alias("status"), F.max("progress").alias("progress"), F.max("last_seen").alias("last_seen"))


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """A stream's rows without those of a key that came before; a key is forgotten when the watermark has passed it by `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
