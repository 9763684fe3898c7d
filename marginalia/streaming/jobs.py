"""Job control on event logs: rate limits, sessions, admission and queue places, in batch and as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.numbering import numbered, running_sums

PER_HOUR, PER_ADDRESS, PENDING, ABANDON_S = 30, 2, 20, 150
KEEP_FINISHED_S, KEEP_DELIVERED_S = 120, 30
STAGES = ("queued", "reading", "analyzing", "done", "error", "cancelled")
FINAL = ("done", "error", "cancelled")


def rate_windows(events: DataFrame, limit: int = PER_HOUR) -> DataFrame:
    """events (event_id, user_id, ts) with the number of the user's events in the hour up to each, and over."""
    hour = Window.partitionBy("user_id").orderBy("ts").rangeBetween(-3_600_000_000, 0)
    micros = events.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    return micros.select("event_id", "user_id", F.count("*").over(hour).alias("in_hour")).withColumn("over", F.col("in_hour") > limit)


def admissions(events: DataFrame, limit: int = PER_HOUR) -> DataFrame:
    """event_id, user_id, accepted by the exact rule: only accepted events count, for an hour. Users' events pass a task in order of time, which holds `limit` of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, recent = None, deque()
        for pdf in batches:
            out = []
            for u, at in zip(pdf["user_id"], pdf["at"]):
                if u != user:
                    user, recent = u, deque()
                while recent and at - recent[0] > 3600:
                    recent.popleft()
                out.append(len(recent) < limit)
                if out[-1]:
                    recent.append(at)
            yield pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "accepted": out})

    timed = events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return timed.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(run, "event_id long, user_id long, accepted boolean")


def submissions(requests: DataFrame, per_hour: int = PER_HOUR, per_address: int = PER_ADDRESS, pending: int = PENDING) -> DataFrame:
    """server, request_id, reason of requests (server, request_id, at, address, ends): null if accepted.

    The rate goes first, then what the address has running, then what the server has; only accepted requests count, and run until `ends`. A server's requests
    pass one task in order of time: what it holds is bounded by the limits and the addresses of an hour.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        server, hits, active = None, {}, []
        for pdf in batches:
            out = []
            for s, at, address, ends in zip(pdf["server"], pdf["at"], pdf["address"], pdf["ends"]):
                if s != server:
                    server, hits, active = s, {}, []
                hits = {a: kept for a, times in hits.items() if (kept := [t for t in times if at - t <= 3600])}
                active = [(a, e) for a, e in active if e > at]
                checks = ((len(hits.get(address, ())) >= per_hour, "rate_limited"), (sum(a == address for a, _ in active) >= per_address, "too_many_active"), (len(active) >= pending, "busy"))
                reason = next((why for hit, why in checks if hit), None)
                if reason is None:
                    hits.setdefault(address, []).append(at)
                    active.append((address, ends))
                out.append(reason)
            yield pd.DataFrame({"server": pdf["server"], "request_id": pdf["request_id"], "reason": out})

    ordered = requests.select("server", "request_id", "at", "address", "ends").repartition("server").sortWithinPartitions("server", "at", "request_id")
    return ordered.mapInPandas(run, "server string, request_id long, reason string")


def edge_limits(requests: DataFrame, per_minute: float, burst: int) -> DataFrame:
    """request_id, address, accepted of requests (request_id, address, at): a leaky bucket for each address, which loses `per_minute` and holds `burst` more than the one it passes on. A refused
    request leaves the bucket as it was. Addresses' requests pass a task in order of time, which holds one bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        address, level, last = None, 0.0, 0.0
        for pdf in batches:
            out = []
            for a, at in zip(pdf["address"], pdf["at"]):
                filled = max(0.0, level - (at - last) * per_minute / 60 + 1) if a == address else 0.0
                address = a
                out.append(filled <= burst + 1e-9)
                if out[-1]:
                    level, last = filled, at
            yield pd.DataFrame({"request_id": pdf["request_id"], "address": pdf["address"], "accepted": out})

    ordered = requests.select("request_id", "address", "at").repartition("address").sortWithinPartitions("address", "at", "request_id")
    return ordered.mapInPandas(run, "request_id long, address string, accepted boolean")


def heartbeat_sessions(events: DataFrame, gap_s: int = ABANDON_S) -> DataFrame:
    """user_id, session, n_events, started and ended (microseconds): runs of events at most gap_s apart."""
    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    timed = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    new = F.coalesce((F.col("at") - F.lag("at").over(order) > gap_s * 1_000_000).cast("int"), F.lit(1))
    runs = timed.withColumn("new", new).withColumn("session", F.sum("new").over(order))
    return runs.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("at").alias("started"), F.max("at").alias("ended"))


def session_stream(events: DataFrame, gap_s: int = ABANDON_S, late: str = "10 minutes") -> DataFrame:
    """The sessions of a stream (ts TIMESTAMP, user_id); a session is given out once the watermark has passed its end."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{gap_s} seconds").alias("session")).agg(F.count("*").alias("n_events"))


def queue_positions(queued: DataFrame, kind: str = "event_type") -> DataFrame:
    """event_id and its place, from 0, among the queued of its kind in order of arrival, numbered by ranges: a queue of any length spans tasks."""
    return numbered(queued.select("event_id", kind, "ts"), [kind], ["ts", "event_id"], "position", "queue").select("event_id", kind, "position")


def job_states(job_events: DataFrame) -> DataFrame:
    """job_id, status, progress of events (job_id, ts, status, progress): the last status before a final one holds on, progress never falls."""
    order = Window.partitionBy("job_id").orderBy("ts")
    final = F.col("status").isin(*FINAL)
    ended = F.max(final.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    live = job_events.withColumn("ended", F.coalesce(ended, F.lit(0))).filter("ended = 0")
    return live.groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.least(F.max("progress"), F.lit(1.0)).alias("progress"))


def expired(jobs: DataFrame, now: float) -> DataFrame:
    """Jobs (status, last_seen, finished, delivered in seconds) that are to be cancelled or purged, with what to do."""
    since = lambda name, most: F.coalesce(now - F.col(name) > most, F.lit(False))
    idle = ~F.col("status").isin(*FINAL) & since("last_seen", ABANDON_S)
    old = since("delivered", KEEP_DELIVERED_S) | since("finished", KEEP_FINISHED_S)
    return jobs.withColumn("action", F.when(idle, F.lit("cancel")).when(old, F.lit("purge"))).filter("action is not null")


def cancellations(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """job_id, existed, status of cancel requests (job_id, place) against jobs (job_id, status): the first takes the job away, so any later one finds none."""
    first = F.row_number().over(Window.partitionBy("job_id").orderBy("place")) == 1
    joined = requests.withColumn("first", first).join(jobs.select("job_id", "status"), "job_id", "left")
    existed = F.col("first") & F.col("status").isNotNull()
    return joined.select("job_id", "place", existed.alias("existed"), F.when(existed, F.when(F.col("status").isin(*FINAL), F.col("status")).otherwise(F.lit("cancelled"))).alias("status"))


def deliveries(fetches: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, at, found, with_report, delivered of fetches (job_id, at) of jobs (job_id, done_at): the first fetch of a finished job sets when it was delivered, and KEEP_DELIVERED_S later, or
    KEEP_FINISHED_S after it was done and never fetched, the job is gone."""
    rows = fetches.join(jobs, "job_id", "left")
    done = F.coalesce(F.col("at") >= F.col("done_at"), F.lit(False))
    in_time = done & (F.col("at") - F.col("done_at") <= KEEP_FINISHED_S)
    first = F.min(F.when(in_time, F.col("at"))).over(Window.partitionBy("job_id"))
    rows = rows.withColumn("delivered", first)
    here = F.col("done_at").isNotNull() & (~done | (F.col("at") <= F.least(F.col("delivered") + KEEP_DELIVERED_S, F.greatest(F.col("done_at") + KEEP_FINISHED_S, F.col("delivered") + KEEP_DELIVERED_S))))
    return rows.select("job_id", "at", F.coalesce(here, F.lit(False)).alias("found"), F.coalesce(here & done, F.lit(False)).alias("with_report"), F.when(done & here, F.col("delivered")).alias("delivered"))


def overall_progress(stages: DataFrame) -> DataFrame:
    """stages (…, stage, fraction) with progress: how far a job is, of reading, and of the steps of the analysis."""
    within = {"split": (0.05, 0.0), "notes": (0.10, 0.55), "merge": (0.65, 0.10), "report": (0.78, 0.0), "verify": (0.92, 0.0), "done": (1.0, 0.0)}
    inner = F.lit(None).cast("double")
    for stage, (start, width) in within.items():
        inner = F.when(F.col("stage") == stage, start + width * F.col("fraction")).otherwise(inner)
    progress = F.when(F.col("stage") == "reading", 0.02 + 0.13 * F.col("fraction")).otherwise(0.15 + 0.85 * inner)
    return stages.withColumn("progress", F.least(F.lit(1.0), progress))


def counters(jobs: DataFrame) -> DataFrame:
    """server, active, waiting, busiest_address of jobs (server, status, address)."""
    active = ~F.col("status").isin(*FINAL)
    by_address = jobs.groupBy("server", "address").agg(F.count_if(active).alias("active"), F.count_if(F.col("status") == "queued").alias("waiting"))
    return by_address.groupBy("server").agg(F.sum("active").alias("active"), F.sum("waiting").alias("waiting"), F.max("active").alias("busiest_address"))


def public(jobs: DataFrame) -> DataFrame:
    """What a client is told of jobs (job_id, status, progress, message, error, ahead): a place in the queue for those that wait."""
    waiting = F.when(F.col("ahead") == 0, F.lit("Waiting for a free worker")).otherwise(F.concat(F.lit("In queue: "), F.col("ahead").cast("string"), F.lit(" document(s) ahead")))
    message = F.when((F.col("status") == "queued") & F.col("ahead").isNotNull(), waiting).otherwise(F.col("message"))
    return jobs.select("job_id", "status", F.round("progress", 3).alias("progress"), message.alias("message"), "error")


def job_stream(job_events: DataFrame) -> DataFrame:
    """The states of a stream of job events, kept by key; an idle job is cancelled by a timeout."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, progress = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "status": ["cancelled"], "progress": [progress]})
            return
        status, progress = state.get if state.exists else ("queued", 0.0)
        for pdf in batches:
            for new, done in zip(pdf.sort_values("ts")["status"], pdf.sort_values("ts")["progress"]):
                if status not in FINAL:
                    status, progress = new, min(1.0, max(progress, float(done)))
        state.update((status, progress))
        state.setTimeoutDuration(1000 * (KEEP_FINISHED_S if status in FINAL else ABANDON_S))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [progress]})

    out = "job_id string, status string, progress double"
    return job_events.groupBy("job_id").applyInPandasWithState(update, out, "status string, progress double", "update", "ProcessingTimeTimeout")


def active_jobs(jobs: DataFrame, server: str = "server") -> DataFrame:
    """server, job_id, active: how many of the server's jobs (server, job_id, starts, ends) run when each starts, itself included; one that ends then doesn't.

    A sweep over starts and ends in order of time: running sums by ranges, so one server's jobs span tasks.
    """
    # ends go before the starts of the same time, but for jobs of no length
    begun = jobs.select(server, "job_id", F.col("starts").alias("at"), F.lit(1).cast("long").alias("step"), F.lit(1).alias("turn"))
    ended = jobs.select(server, F.lit(None).cast(jobs.schema["job_id"].dataType).alias("job_id"), F.greatest("starts", "ends").alias("at"), F.lit(-1).cast("long").alias("step"), F.when(F.col("ends") > F.col("starts"), 0).otherwise(2).alias("turn"))
    sums = running_sums(begun.unionByName(ended), [server], ["at", "turn"], "step", "sum", "active")
    # of those that start at once each counts all
    here = sums.filter("step = 1").groupBy(server, "at").agg(F.max("sum").alias("active"))
    return begun.join(here, [server, "at"]).select(server, "job_id", "active")
