"""Decontamination against full dynamic programming."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from marginalia.llm import decontaminate as D
from marginalia.llm.common import table


def fewest_edits(item, text):
    row = np.zeros(len(text) + 1, np.int64)
    a, k = D.codes(text), np.arange(len(text) + 1)
    for i, c in enumerate(D.codes(item)):
        step = np.concatenate([[i + 1], np.minimum(row[:-1] + (a != c), row[1:] + 1)])
        row = np.minimum.accumulate(step - k) + k
    return int(row.min())


def brute(docs, items):
    out = []
    for d, t in docs:
        for i, x in items:
            x = D.normalise(x or "")
            if len(x) >= D.LEAST_CHARS and (e := fewest_edits(x, D.normalise(t or ""))) <= int(D.EDIT_RATE * len(x)):
                out.append((d, i, e))
    return sorted(out, key=str)


def got(docs, items):
    return sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in D.find_leaks(docs, items).collect()), key=str)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        roll = rng.random()
        if roll < 0.34:
            text[at] = rng.choice("xyzq")
        elif roll < 0.67:
            text.insert(at, rng.choice("xyzq"))
        else:
            del text[at]
    return "".join(text)


def cases():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "er", "on", "é", "re", "in"]) for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([8, 12, 20, 40, 60, 90, 3])]
    items += [(20, items[2][1]), (21, None), (22, ""), (None, items[3][1][::-1])]
    docs = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 2)):
            text = items[rng.randrange(6)][1]
            parts.append(edited(rng, text, rng.randint(0, int(0.1 * len(text)))))
            parts.append("\n".join(word() for _ in range(rng.randint(0, 30))))
        docs.append((d, " ".join(parts).upper() if d % 7 == 0 else "  ".join(parts)))
    return docs + [(70, None), (71, ""), (72, items[0][1]), (72, items[0][1]), (None, items[1][1]), (73, word() * 30000 + items[4][1])], items


def test_whole_small_table(spark, sf_dir):
    docs, items = (table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    result = got(docs, items)
    plain = {D.normalise(r["text"]): r["item_id"] for r in items.collect()}
    exact = {(r["doc_id"], i) for r in docs.collect() for t, i in plain.items() if t in D.normalise(r["text"])}
    assert {(d, i) for d, i, e in result if e == 0} == exact and len(result) >= len(exact) > 0


def test_edits_and_odd_rows(spark, monkeypatch):
    docs, items = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as edits")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 20
    assert got(frame, bench) == want
    monkeypatch.setattr(D, "BLOCK_CHARS", 800_000)
    assert got(frame, bench) == want
    kept = D.drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    leaking = {d for d, _, _ in want}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - leaking
    assert got(frame.limit(0), bench) == [] == got(frame, bench.limit(0))


def test_many_rows_long_items_and_equal_characters():
    """20,000 rows, an item of 1 M characters, and a text whose every q-gram is the same."""
    rng = random.Random(9)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    index = D.Index([(1, item), (2, "a" * 500), (3, long)])
    rows = ["short row"] * 19_990 + [item, "a" * 300_000, long[5000:9000]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows)], names=["doc_id", "text"])
    shared = type("Shared", (), {"value": index})
    tracemalloc.start()
    found = [tuple(r.values()) for b in D.leak_batches(shared)(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(d, i, e) for d, i, e, _ in found] == [(19_990, 1, 0), (19_991, 2, 0)]
    assert peak < 400 << 20
