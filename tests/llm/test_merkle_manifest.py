import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from marginalia.llm import merkle_manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The top of a tree, and for each node its siblings, with the side that they are on."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            other = i ^ 1
            path.append((nodes[other] if other < len(nodes) else "", other < i))
        at = [i // 2 for i in at]
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows):
    lanes = {}
    for r in rows:
        lanes.setdefault(r[2], []).append((r, leaf(*r)))
    first = lambda x: (x is not None, x)
    order = sorted(lanes, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in order:
        lanes[lang].sort(key=lambda x: (first(x[0][0]), x[1]))
        trees[lang] = climb([h for _, h in lanes[lang]])
    root, upper = climb([trees[lang][0] for lang in order]) if order else (None, [])
    out = []
    for lang, above in zip(order, upper):
        subroot, paths = trees[lang]
        for (r, h), path in zip(lanes[lang], paths):
            whole = path + above
            start = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                start = leaf(*r[:4], r[4] + 1)
            for other, before in whole:
                start = sha(other, start) if before else sha(start, other)
            out.append((r[0], h, subroot, root, sha(*(o for o, _ in whole)), start, start == root))
    return sorted(out, key=str)


def run(spark, docs):
    found = M.manifest(docs).withColumn("folded_root", M.folded(F.col("start"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", M.sha(M.siblings(F.col("path"))), "folded_root", F.col("folded_root") == F.col("root"))


def same(spark, rows, docs=None):
    docs = spark.createDataFrame(rows, SCHEMA) if docs is None else docs
    assert sorted(map(tuple, run(spark, docs).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "é text", "en", "a", 6), (2, "", "en", None, 0), (3, None, None, "b", None), (None, "x", "", "b", 1), (5, "long " * 20_000, "ñ", "c", 100_000)]
    rows += [(7, "same", "en", "a", 4)] * 3 + [(7, "other", "en", "a", 5), (None, None, None, None, None), (9, "n", "zz", "s", 2**63 - 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit("clash") for name in ("pos", "of", "lane", "hash", "group", "path", "part", "row", "tie")})
    same(spark, rows, docs)


@pytest.mark.parametrize("n", [1, 2, 3, 256, 257, 700])
def test_one_language_and_several_tiers(spark, n):
    same(spark, [(i, f"text {i}", "en", "s", i) for i in range(n)])


def test_many_languages(spark):
    same(spark, [(i, f"text {i}", f"l{i % 290}", "s", i) for i in range(600)])


def test_empty_table(spark):
    assert run(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_changed_field_fails_and_an_unchanged_one_holds(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(40)]
    found = {r["doc_id"]: r for r in M.manifest(spark.createDataFrame(rows, SCHEMA)).withColumn("again", M.folded(M.sha(F.lit("no such leaf")), F.col("path"))).withColumn("kept", M.folded(F.col("leaf"), F.col("path"))).collect()}
    assert all(r["again"] != r["root"] and r["kept"] == r["root"] for r in found.values())


def test_upper_tiers_are_a_group_in_size(spark):
    """Leaves are dealt out by group once; the tables above have a row for each group."""
    nodes = M.numbered(M.leaves(spark.createDataFrame([(i, "t", "en", "s", i) for i in range(1000)], SCHEMA)), ["lane"], ["doc_id", "hash", "start"], "pos").withColumnRenamed("pos_of", "of")
    groups = M.tier(nodes, ["lane"], ["doc_id", "start"])
    assert sorted((r["pos"], len(r["nodes"]), len(r["preimages"])) for r in groups.collect()) == [(0, 256, 8), (1, 256, 8), (2, 256, 8), (3, 232, 8)]
