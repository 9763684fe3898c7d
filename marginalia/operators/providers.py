"""Choosing among model providers, and what their answers mean, as columns of attempt logs.

An annotator that calls models runs where the chunks are; these rules decide, row by row, whom a call goes to and what follows from its outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T

# Waiting times in seconds, and the ceiling of a second, longer answer.
MOST_WAIT, LEAST_COOLDOWN, SERVER_WAIT, PAYLOAD_WAIT, TIMEOUT_WAIT, NETWORK_WAIT, OUTPUT_CAP = 65.0, 2.0, 3.0, 1.0, 5.0, 2.0, 12_000


def choose(calls: DataFrame) -> DataFrame:
    """call_id, provider, wait of calls (call_id, now, provider, place, disabled, skipped, failed, cooldown_until, in_flight): one row for each call and provider.

    Usable are those neither disabled nor skipped; ready are those not cooling down, and of these the ones that did not fail this call go first. Of
    them the one with the fewest requests in flight is taken, else the one that cools down first. No usable provider: null.
    """
    usable = ~F.col("disabled") & ~F.col("skipped")
    ready = F.col("cooldown_until") <= F.col("now")
    rank = F.when(ready & ~F.col("failed"), F.lit(0)).when(ready, F.lit(1)).otherwise(F.lit(2))
    best = F.min(F.when(usable, F.struct(rank.alias("rank"), F.when(ready, F.col("in_flight").cast("double")).otherwise(F.col("cooldown_until")).alias("by"), "place", "provider", F.greatest(F.col("cooldown_until") - F.col("now"), F.lit(0.0)).alias("wait"))))
    return calls.groupBy("call_id").agg(best.alias("x")).select("call_id", "x.provider", F.when(F.col("x.rank") < 2, F.lit(0.0)).otherwise(F.least("x.wait", F.lit(MOST_WAIT))).alias("wait"))


def outcomes(attempts: DataFrame) -> DataFrame:
    """attempts (…, status, body, retry_after, content, truncated, failure) with action and cooldown.

    status is null where no answer came: failure is then `timeout` or `network`. content is null for a payload that can't be read.
    """
    status, text = F.col("status"), F.lower(F.coalesce("body", F.lit("")))
    large = (status == 413) | ((status == 400) & F.contains(text, F.lit("too large")))
    empty = F.col("content").isNull() | (T.stripped(F.coalesce("content", F.lit(""))) == "")
    action = (
        F.when(status.isNull(), F.lit("retry"))
        .when(status.isin(401, 402, 403, 404), F.lit("disable"))
        .when(large, F.lit("skip"))
        .when((status == 429) | (status >= 500), F.lit("retry"))
        .when(status >= 400, F.lit("fail"))
        .when(F.col("truncated"), F.lit("double"))
        .when(empty, F.lit("retry"))
        .otherwise(F.lit("use"))
    )
    cooldown = (
        F.when(F.col("failure") == "timeout", F.lit(TIMEOUT_WAIT))
        .when(status.isNull(), F.lit(NETWORK_WAIT))
        .when(status == 429, F.greatest(T.retry_delay(F.coalesce("retry_after", F.lit("")), F.coalesce("body", F.lit(""))), F.lit(LEAST_COOLDOWN)))
        .when(status >= 500, F.lit(SERVER_WAIT))
        .when((status < 400) & ~F.col("truncated") & empty, F.lit(PAYLOAD_WAIT))
        .otherwise(F.lit(0.0))
    )
    return attempts.withColumns({"action": action, "cooldown": cooldown})


def hedged(calls: DataFrame, after: float) -> DataFrame:
    """calls (…, first_s, first_ok, second_s, second_ok) with hedged, answer and seconds: a call that says nothing for `after` seconds is made a second time, and the first answer counts."""
    late = F.col("first_s") > after
    first, second = F.when(F.col("first_ok"), F.col("first_s")), F.when(late & F.col("second_ok"), after + F.col("second_s"))
    fails = F.greatest("first_s", F.when(late, after + F.col("second_s")))
    seconds = F.coalesce(F.least(first, second), fails)
    answer = F.when(first.isNull() & second.isNull(), F.lit("error")).when(first.isNull() | (second < first), F.lit("second")).otherwise(F.lit("first"))
    return calls.withColumns({"hedged": late, "answer": answer, "seconds": seconds})


def next_budget(tokens: Column) -> Column:
    """What a cut-off answer may be long the second time."""
    return F.least(tokens * 2, F.greatest(tokens, F.lit(OUTPUT_CAP)))


def used_providers(attempts: DataFrame) -> DataFrame:
    """job_id, models_used, calls of attempts (job_id, provider, action): calls that gave an answer, and by whom, the busiest first."""
    counts = attempts.filter(F.col("action") == "use").groupBy("job_id", "provider").agg(F.count("*").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "provider")))
    return counts.groupBy("job_id").agg(F.transform(ranked, lambda x: x["provider"]).alias("models_used"), F.sum("n").alias("calls"))


def base_names(names: Column) -> Column:
    """Providers without their slot numbers, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(names, lambda x: F.split_part(x, F.lit("#"), F.lit(1)))))
