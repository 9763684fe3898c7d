"""Queries that need only values of a text must not move or keep texts."""

import pytest

from marginalia.operators import numbering
from marginalia.operators import pages as P
from marginalia.plans import catalogue as C


@pytest.mark.parametrize("name", ["analysis_chars", "strategy_switch", "chunk_pack", "unreadable_docs", "doc_garbled_upper_median"])
def test_no_text_is_numbered(spark, sf_dir, monkeypatch, name):
    kept, seen = numbering.kept, []
    monkeypatch.setattr(numbering, "kept", lambda df, kind: (seen.append(df.columns), kept(df, kind))[1])
    assert C.QUERIES[name](spark, sf_dir).count()
    assert not [c for c in seen if {"text", "block"} & set(c)]


def test_spans_and_strategies_of_odd_pages(spark):
    texts = [("a", 1, "x" * 70_000 + ". Y" * 12_000), ("a", 2, " \n"), ("a", 3, "short"), ("a", 4, None), ("b", 1, " " * 120_000 + "one"), ("c", 1, "word " * 30_000), ("d", 1, "\x1c" * 120_000), ("e", 1, " " * 120_000), ("e", 2, "t" * 29_000), ("e", 3, "u" * 2_000)]
    df = spark.createDataFrame(texts, "doc string, page_no int, text string")
    want = P.chunks(df).selectExpr("doc", "chunk_idx", "pages", "length(text) AS n_chars").collect()
    got = P.chunk_spans(df.select("doc", "page_no", P.piece_lengths().alias("lengths"))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    counts = {r["doc"]: r["n"] for r in P.chunks(df).groupBy("doc").count().selectExpr("doc", "count AS n").collect()}
    assert {r["doc"]: r["strategy"] for r in P.strategies(df).collect()} == {d: "single-pass" if counts.get(d) == 1 else "map-reduce" for d in "abcde"}
