import random

import pytest

from marginalia.operators import greedy as G
from marginalia.operators import pages as P


def loop(costs, most, gap, least):
    """first and last of each run, by the plain rule."""
    out, first, held = [], 0, 0
    for i, c in enumerate(costs):
        if i - first >= least and held + c > most:
            out.append((first, i - 1))
            first, held = i, 0
        held += c + gap
    return [*out, (first, len(costs) - 1)] if costs else []


@pytest.mark.parametrize(("gap", "least", "segment"), [(2, 1, 4096), (2, 1, 8), (0, 2, 8), (0, 1, 5)])
def test_runs_are_those_of_the_loop(spark, monkeypatch, gap, least, segment):
    """Also where a document has many segments, and a run ends in the next one."""
    monkeypatch.setattr(G, "SEGMENT", segment)
    rng, most = random.Random(segment + least), 40
    docs = {f"d{n}": [rng.choice((12, 13, 20, 39, 60)) for _ in range(n)] for n in (1, 2, 3, 7, 8, 9, 40, 333)} | {"same": [12] * 200, "long": [90] * 50}
    rows = [(d, i, c) for d, costs in docs.items() for i, c in enumerate(costs)]
    rng.shuffle(rows)
    got: dict = {}
    for r in G.runs(spark.createDataFrame(rows, "doc string, idx long, cost long"), most, gap, least, least_cost=12).collect():
        got.setdefault(r["doc"], []).append((r["run"], r["first"], r["last"]))
    assert {d: sorted(x) for d, x in got.items()} == {d: [(k, a, b) for k, (a, b) in enumerate(loop(costs, most, gap, least))] for d, costs in docs.items()}


def test_no_items(spark):
    assert G.runs(spark.createDataFrame([], "doc string, idx long, cost long"), 10).collect() == []


def test_one_document_over_many_segments_packs_as_the_loop_does(spark, monkeypatch):
    monkeypatch.setattr(G, "SEGMENT", 16)
    rng = random.Random(9)
    texts = [rng.choice(("", " \n\t", " ", "a", "word " * rng.randrange(1, 9), "First. Second one! Third? " * 9)) for _ in range(150)]
    rows = [("d", i + 1, t) for i, t in enumerate(texts)] + [("e", 1, "x")]
    want, parts, numbers, size = [], [], [], 0
    for i, t in enumerate(texts):
        for piece in P.split_long(t, 100) if t.strip() else []:
            block = f"[[Page {i + 1}]]\n{piece}"
            if parts and size + len(block) > 100:
                want.append((numbers, "\n\n".join(parts)))
                parts, numbers, size = [], [], 0
            parts.append(block)
            size += len(block) + 2
            numbers = numbers if i + 1 in numbers else [*numbers, i + 1]
    want.append((numbers, "\n\n".join(parts)))
    got = P.chunks(spark.createDataFrame(rows, "doc string, page_no int, text string"), 100).collect()
    assert [(list(r["pages"]), r["text"]) for r in sorted((r for r in got if r["doc"] == "d"), key=lambda r: r["chunk_idx"])] == want
    assert [r["chunk_idx"] for r in got if r["doc"] == "e"] == [0]
