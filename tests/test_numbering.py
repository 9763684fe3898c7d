import pytest
from pyspark.sql import functions as F

from marginalia.operators.numbering import numbered, ranged


def expected(rows):
    groups = {}
    for g, o in rows:
        groups.setdefault(g, []).append(o)
    return sorted(((g, o, i, len(x)) for g, x in groups.items() for i, o in enumerate(sorted(x, key=lambda o: (o is not None, o)))), key=str)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("a", 1)] * 50, [("hot", i % 700) for i in range(3000)] + [(None, i) for i in range(9)] + [(f"g{i % 20}", None if i % 3 else i) for i in range(100)]])
def test_numbers_are_those_of_a_window(spark, rows):
    df = spark.createDataFrame(rows, "g string, o int").repartition(5)
    assert sorted(map(tuple, numbered(df, ["g"], ["o"], "n").collect()), key=str) == expected(rows)


def test_no_group_numbers_all_rows(spark):
    got = numbered(spark.range(0, 500, 1, 7).select((499 - F.col("id")).alias("x")), [], ["x"], "n").collect()
    assert {r["x"]: r["n"] for r in got} == {i: i for i in range(500)} and {r["n_of"] for r in got} == {500}


def test_a_group_spans_many_ranges(spark):
    """Even one key that holds all rows, and repeats."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ranged(spark.range(0, 8000, 1, 8).select(F.lit("hot").alias("g"), F.lit(1).alias("o")), ["g"], ["o"], "t").groupBy("part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 3000


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError):
        numbered(spark.range(3).withColumn("part", F.lit(1)), [], ["id"], "n")


def test_active_jobs_by_a_loop(spark):
    from marginalia.streaming.jobs import active_jobs

    jobs = [("s", i, i * 7 % 40, i * 7 % 40 + i % 9) for i in range(120)] + [("t", 1, 5, 5), ("t", 2, 5, 9), ("t", 3, 9, 10)] + [(None, 1, 0, 3)]
    df = spark.createDataFrame(jobs, "server string, job_id long, starts long, ends long")
    want = {(s, j): sum(b[0] == s and (b[2] <= a < b[3] or b[2] == a == b[3]) for b in jobs) for s, j, a, _ in jobs if s is not None}
    assert {(r["server"], r["job_id"]): r["active"] for r in active_jobs(df).filter("server is not null").collect()} == want
