"""Checks of quotes, numbers and claims whose work grows with the input alone."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import grounding as G


def test_quotes_meet_pages_by_grams(spark, monkeypatch):
    """No document's needles are dealt out to all its pages, and the first page is that of a plain search."""
    monkeypatch.setattr(G, "needle_pages", lambda *a, **k: pytest.fail("needles times pages"))
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé漢") for _ in range(rng.randint(1, 6)))
    pages = [(d, p, " ".join(word() for _ in range(60))) for d in "xy" for p in range(1, 21)]
    quotes, want = [], {}
    for k in range(200):
        doc, _, text = rng.choice(pages)
        at = rng.randrange(len(text) - 60)
        quote = text[at : at + rng.randint(15, 50)].strip() if k % 2 else " ".join(word() for _ in range(8))
        if len(quote) >= 15:
            quotes.append((doc, k, quote, None, []))
            want[k] = min((p for d, p, t in pages if d == doc and quote in t), default=None)
    index = spark.createDataFrame(pages, "doc string, page_no int, norm string")
    found = G.verify_evidence(index, spark.createDataFrame(quotes, "doc string, quote_id int, quote string, declared int, section_pages array<int>"))
    assert {r["quote_id"]: r["page"] for r in found.collect()} == want and any(want.values()) and None in want.values()


def test_metrics_keep_first_pages_and_cited_ones(spark):
    pages = [("d", p, f"a {p % 7} b {100 + p % 3} c{p}") for p in range(1, 41)]
    metrics = [("d", 1, "3", []), ("d", 2, "101", [40, 22, 7]), ("d", 3, "999", [2]), ("d", 4, "b 102", []), ("d", 5, "102", [1])]
    index = spark.createDataFrame(pages, "doc string, page_no int, norm string")
    got = {r["metric_id"]: tuple(r)[4:] for r in G.verify_metrics(index, spark.createDataFrame(metrics, "doc string, metric_id int, value string, cited array<int>")).collect()}
    holds = lambda v: [p for _, p, t in pages if v in t]
    assert got[1] == (holds("3")[:4], True, False) and got[4][0] == holds("102")[:4]
    assert got[2] == ([7, 22, 40], True, False) and got[3][:2] == ([2], False) and got[5] == (holds("102")[:4], True, True)
    kept = G.first_runs(index).select(F.explode(F.split("norm", " ")).alias("r")).groupBy("r").count().agg(F.max("count")).first()[0]
    assert kept <= G.METRIC_PAGES


def test_claims_are_gathered_once(spark):
    rows = [("d", i, raw) for i, raw in enumerate(['[1, "2-4", null, true, 9]', '"p. 3"', "[]", None, "null", "2.5", "2"])]
    claims = spark.createDataFrame(rows, "doc string, claim_id int, raw string").withColumn("raw", F.parse_json("raw"))
    found = G.claimed_pages(claims, spark.createDataFrame([("d", p) for p in (1, 2, 3)], "doc string, page_no int"))
    assert [tuple(r)[1:] for r in found.orderBy("claim_id").collect()] == [(0, [1, 2, 3], 4), (1, [3], 0), (2, [], 0), (3, [], 0), (4, [], 0), (5, [], 1), (6, [2], 0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
