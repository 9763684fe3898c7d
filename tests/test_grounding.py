"""Needles, numbers and notes against plain loops."""

import json
import random

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import grounding as G
from marginalia.operators import notes as N
from marginalia.operators import pages as P
from marginalia.plans import catalogue
from marginalia.sources.tables import pages


def test_needles_in_parts_and_slices(spark, monkeypatch):
    monkeypatch.setattr(G, "NEEDLES", 4)
    monkeypatch.setattr(G, "SLICE_BYTES", 60)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abé", k=rng.randrange(1, 4)))
    rows = [(d, p, " ".join(word() for _ in range(rng.randrange(0, 30)))) for d in ("x", "y", "z") for p in range(1, 20)]
    needles = sorted({(d, " ".join(word() for _ in range(rng.randrange(1, 3)))) for d in ("x", "y", "w") for _ in range(30)})
    index, wanted = spark.createDataFrame(rows, "doc string, page_no int, norm string"), spark.createDataFrame(needles, "doc string, needle string")
    want = {(d, n, p) for d, n in needles for e, p, text in rows if d == e and n in text}
    assert {tuple(r) for r in G.needle_pages(index, wanted).collect()} == want
    first = {(d, n): min(p for e, m, p in want if (e, m) == (d, n)) for d, n, _ in want}
    assert {(r[0], r[1]): r[2] for r in G.needle_pages(index, wanted, first=True).collect()} == first
    assert G.needle_pages(index, wanted.limit(0)).collect() == [] and G.needle_pages(index.limit(0), wanted).collect() == []


def test_numbers_are_whole_tokens(spark):
    """The inverted index says what the pattern says on each page."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("12.,x ", k=rng.randrange(1, 25))) for _ in range(150)] + ["12", "1.2.3", "12,, 1", ".5", "5.", "1,,2", "7.x"]
    index = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, page_no int, norm string")
    numbers = spark.createDataFrame([("d", n) for n in ("1", "2", "12", "1.2", "1,", "12,", "1,2", "2.1", "21", "1,,2", "5")], "doc string, number string")
    want = index.crossJoin(numbers.select("number")).filter(T.has_number(F.col("norm"), F.col("number"))).select("number", "page_no")
    got = G.number_pages(index, numbers).select("number", "page_no")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_metrics_of_several_numbers_and_words(spark):
    texts = ["rate 12 of 40 and 7", "40 12", "12 only", "rate 12 of 40", "112 405", "no number"]
    index = G.page_index(spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc string, page_no int, text string"))
    rows = [("d", 1, "12 of 40", []), ("d", 2, "rate", []), ("d", 3, "12", [3]), ("d", 4, "7 9", [2]), ("d", 5, "5", []), ("d", 6, "", [1]), ("e", 7, "12", [1]), ("d", 8, "40 12", [6])]
    got = {r["metric_id"]: (list(r["pages"]), r["verified"], r["relocated"]) for r in G.verify_metrics(index, spark.createDataFrame(rows, "doc string, metric_id int, value string, cited array<int>")).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: ([1, 2, 4], True), 2: ([1, 4], True), 3: ([3], True), 4: ([2], False), 5: ([5], True), 6: ([1], False), 7: ([1], False), 8: ([1, 2, 4], True)}
    assert got[8][2] and not got[3][2]


def test_chunk_notes_by_a_loop(spark, sf_dir):
    """Pages, chunks, notes, quotes and merges of the whole table, a document at a time."""
    docs: dict = {}
    for r in pages(spark, sf_dir).collect():
        docs.setdefault(r["doc"], []).append((r["page_no"], r["text"] or ""))
    want = {}
    for doc, own in docs.items():
        own.sort()
        norms = [(p, T.comparable(t)) for p, t in own]
        chunks, parts, numbers, size = [], [], [], 0
        for p, t in own:
            for piece in P.split_long(t, P.CHUNK_CHARS) if t.strip() else []:
                block = f"[[Page {p}]]\n{piece}"
                if parts and size + len(block) > P.CHUNK_CHARS:
                    chunks.append((numbers, "\n\n".join(parts)))
                    parts, numbers, size = [], [], 0
                parts.append(block)
                size += len(block) + 2
                numbers = numbers if p in numbers else [*numbers, p]
        chunks.append((numbers, "\n\n".join(parts)))
        notes = []
        for numbers, text in chunks:
            note, found = N.extract_notes(text), {}
            for i, quote, near in N.quotes_of(note, set(numbers)):
                needle = T.comparable(quote)
                order = [*near, *(p for p, _ in norms)]
                held = {p for p, norm in norms if needle in norm} if len(needle) >= T.MIN_QUOTE else set()
                hit = next((p for p in order if p in held), None)
                if hit is not None:
                    found[i] = hit
            notes.append(N.sanitize(note, numbers, found))
        want[doc] = N.reduce_notes(notes, 45_000)
    got = {r["doc"]: json.loads(r["notes"]) for r in catalogue.QUERIES["chunk_notes"](spark, sf_dir).collect()}
    assert got == want
