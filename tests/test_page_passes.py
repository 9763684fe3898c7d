"""Pages are scored, cleaned and indexed once each, by the same rules as the columns that built-ins make."""

import os
import random
import re

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import extraction as E
from marginalia.operators import grounding as G
from marginalia.operators import notes as N
from marginalia.operators import pages as P
from marginalia.plans import catalogue
from marginalia.sources import shared


def texts():
    rng = random.Random(4)
    parts = ["river", "Straße", "ÀÉ", "ßß", "x", "a1b2", "...", "$1,200.50", "-\n", "a-\nb-\nc", "  ", "\t", " \n ", "\n\n\n", "\n", " ", "×", "÷", "ÿ", "_", "%", "No-\n1", "Page 3", "qwrtz", "Ab.", "abc,", "ab,"]
    odd = ["‘quoted’", "ﬁne", "\x0b", "\r\n", "\x1c", "\xa0", "漢字", "é", " ", "²", "µ", "\x00"]
    safe = ["".join(rng.choice(parts) + rng.choice(("", " ", " ")) for _ in range(rng.randrange(30))) for _ in range(300)]
    return [None, "", " ", "\n\t ", "a", "$", *safe, *("".join(rng.choice(parts + odd) + rng.choice(("", " ")) for _ in range(rng.randrange(30))) for _ in range(200))]


def test_python_equals_the_built_in_columns(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "id int, text string")
    text = F.col("text")
    scores = T.page_scores(text)
    pairs = {"tidy": (T.page_tidy("text"), T.tidy_column(text)), "norm": (T.page_match_form("text"), T.match_form(text)), "n": (scores["n_chars"], F.length(T.stripped(text))), "quality": (scores["quality"], T.text_quality(text)), "solid": (T.solid(text), T.stripped(text) != "")}
    rows = df.select("id", "text", *(c.alias(f"{name}{i}") for name, two in pairs.items() for i, c in enumerate(two))).collect()
    for r in rows:
        for name in pairs:
            assert r[f"{name}0"] == r[f"{name}1"], (name, r["text"])


def test_known_edges_equal_edge_lines(spark):
    rng = random.Random(2)
    heads = ["Journal of Ice 12", "  Page 7 ", "x" * 81, "", " ", "Draft"]
    rows = [(doc, i, "\n".join(rng.choice(heads) for _ in range(rng.randrange(7)))) for doc in "abcd" for i in range(rng.choice((3, 5, 9, 30)))] + [("e", 1, None)]
    pages = spark.createDataFrame(rows, "doc string, page_no int, text string")
    got = P.strip_known_edges(pages.withColumn("edges", P.edge_keys(F.col("text"))))
    assert sorted(map(tuple, got.select(pages.columns).collect()), key=str) == sorted(map(tuple, P.strip_repeated_lines(pages).collect()), key=str)


def test_notes_equal_whole_lists():
    rng = random.Random(3)
    parts = ["The flow fell by 41.2 %", "$5", "$", "$$7", "1,2,3.", "Rivers", "aRivers", "_Rivers", "Éclairs", "Windows2", ". ", "? ", "\n", " ", "Winter", "ice cover lasted for 87 days", "٣"]
    for _ in range(300):
        body = "".join(rng.choice(parts) + rng.choice(("", " ")) for _ in range(rng.randrange(60)))
        line = " ".join(body.split())
        assert [m[0] for m in N.FIGURE.finditer(line)] == [m[0] for m in re.finditer(r"\$?\d[\d,]*(?:\.\d+)?(?: ?%)?", line)]
        assert N.CAPITALISED.findall(body) == re.findall(r"\b[A-Z][a-z]{5,}\b", body)
        assert N.figures(line, 4) == N.figures(line)[:4]
        assert list(N.long_sentences(line)) == [s.strip() for s in re.split(r"(?<=[.!?])\s+", line) if len(s.strip()) >= 40]


def test_texts_are_scored_cleaned_and_indexed_once(spark, sf_dir, monkeypatch):
    seen, write = [], shared.kept
    for module in (catalogue, E, G, P, N):
        if hasattr(module, "kept"):
            monkeypatch.setattr(module, "kept", lambda df, kind: (seen.append(kind), write(df, kind))[1])
    monkeypatch.setattr(shared, "kept", lambda df, kind: (seen.append(kind), write(df, kind))[1])
    assert catalogue.QUERIES["corpus_reports"](spark, sf_dir).count()
    assert seen.count("index") == 1 and seen.count("scored-pages") == 1 and seen.count("clean-pages") == 1


def test_tables_of_texts_go_when_they_are_used(spark, sf_dir, monkeypatch):
    gone, forget = [], shared.forget
    table = shared.kept(spark.range(3), "of-a-test")
    files = table.inputFiles()
    forget(spark.read.parquet(f"{sf_dir}/documents.parquet"), table)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files) and os.path.exists(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(catalogue, "forget", lambda *tables: (gone.extend(f.split("/marginalia-")[1].split("/")[0].rpartition("-")[0] for df in tables for f in df.inputFiles()), forget(*tables)))
    assert catalogue.QUERIES["corpus_reports"](spark, sf_dir).count()
    assert {"pages", "scored-pages", "clean-pages", "final-pages", "told", "chunk-blocks", "chunks"} <= set(gone)
