"""Near duplicates against all pairs."""

import gc
import random

import numpy as np
import pyarrow as pa

from marginalia.llm import near_dedup as N
from marginalia.llm.common import Scratch, table, trim


def brute(rows):
    """Classes by exact similarity of all pairs of texts."""
    sets = [N.weighted_set((t or "").encode()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            (a, _), (b, _) = sets[i], sets[j]
            if len(a) and len(b) and (rows[i][1] == rows[j][1] or (min(len(a), len(b)) >= 0.5 * max(len(a), len(b)) and len(np.intersect1d(a, b, True)) and N.similarity(sets[i], sets[j]) >= N.SIMILARITY)):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, least.get(find(i))) for i, (doc, _) in enumerate(rows) if doc is not None)


def got(df, exact=False):
    return sorted((r["doc_id"], r["class_id"]) for r in N.near_duplicates(df, exact).collect() if r["doc_id"] is not None)


def test_whole_small_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_chains_groups_and_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):  # near copies of one text, each with an edit of its own
        words = list(base)
        words[rng.randrange(120)] = word()
        rows.append((i, " ".join(words)))
    chain = [word() for _ in range(100)]
    for i in range(12):  # each resembles only the next
        chain[8 * i] = word()
        rows.append((100 + i, " ".join(chain)))
    passage = " ".join(word() for _ in range(60))
    rows += [(200 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(20)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "one two"), (305, "one two"), (305, "one two"), (None, "one two"), (306, word() * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as bands", "3 as u", "'x' as source")
    result = got(df)
    assert result == brute(rows)
    assert len({c for d, c in result if d < 60}) == 1 and len({c for d, c in result if 300 <= d < 303}) == 3


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 2)
    rows = [(i, f"{'a b c d e f g h ' * 8} w{i // 2} x{i // 2} y{i // 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, exact=True) == brute(rows)


def test_query_and_pipeline_stage_leave_no_pair_out(spark, tmp_path, monkeypatch):
    """What the rounds leave apart is compared in blocks. Here no round proposes anything."""
    monkeypatch.setattr(N, "ROUNDS", 0)
    monkeypatch.setattr(N.Links, "to_hubs", lambda self: self.verify(spark.createDataFrame([], "u binary, v binary")))
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = edited(random.Random(11), 60, 3)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs, want = table(spark, str(tmp_path), "documents"), brute(rows)
    assert got(docs) != want
    assert sorted((r["doc_id"], r["class_id"]) for r in N.op4_near_dedup(spark, str(tmp_path)).collect()) == want
    assert {r["doc_id"] for r in N.keep_one(docs).collect()} == {c for _, c in want}


def edited(rng, n, edits):
    """n near copies of one text of 120 words, with 1 to `edits` words changed."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, out = [word() for _ in range(120)], []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(1, edits)):
            words[rng.randrange(120)] = word()
        out.append((i, " ".join(words)))
    return out


def test_pairs_grow_with_members(spark, monkeypatch):
    """Texts that resemble each other by less than the threshold must not be compared all with all."""
    made, verify = [], N.Links.verify

    def counted(self, pairs):
        pairs = self.scratch.keep(pairs, "counted")
        made[-1] += pairs.count()
        return verify(self, pairs)

    monkeypatch.setattr(N.Links, "verify", counted)
    for n in (300, 900):
        made.append(0)
        rows = edited(random.Random(5), n, 3)
        result = got(spark.createDataFrame(rows, "doc_id long, text string"))
        if n == 300:  # of the pairs that belong together, at least 0.9 are found; nothing is joined that doesn't
            want = dict(brute(rows))
            found = dict(result)
            together = [(i, j) for i in range(n) for j in range(i) if want[i] == want[j]]
            assert sum(found[i] == found[j] for i, j in together) >= 0.9 * len(together)
            assert all(want[i] == want[j] for i in range(n) for j in range(i) if found[i] == found[j])
    assert made[1] / 900 < 1.3 * made[0] / 300, made


def test_short_texts_take_few_turns(monkeypatch):
    """A text of one window draws over a thousand arrivals; each turn of one costs as much as a turn of many."""
    turns, mix = [], N.mix
    monkeypatch.setattr(N, "mix", lambda x: turns.append(1) or mix(x))
    sets = [N.weighted_set(b"one two"), N.weighted_set(b"a b c d e f g"), N.weighted_set(b" ".join(b"w%d" % i for i in range(500)))]
    together = N.signatures(sets)
    assert len(turns) < 200
    for one, row in zip(sets, together):  # the arrivals are the same ones, however many are drawn at a time
        monkeypatch.setattr(N, "ARRIVALS", 1)
        assert (N.signatures([one])[0] == row).all()


def test_sets_of_many_texts_are_those_of_each():
    texts = [b"", None, b"a", b"a b c d", b"a b c d e", b" \n", b"x y x y x y x y x y", b"a b c d e f"]
    for got_set, text in zip(N.weighted_sets(texts), texts, strict=True):
        assert all((x == y).all() and len(x) == len(y) for x, y in zip(got_set, N.weighted_set(text)))


def test_blocks_come_in_batches_and_give_memory_back_once(monkeypatch):
    """Many small groups and one large one, whose rows come in several batches."""
    trims = []
    monkeypatch.setattr(N, "trim", lambda: trims.append(1))
    rng, rows = random.Random(7), []
    for g, n in enumerate([2] * 40 + [30] + [3] * 40):
        texts = [t for _, t in edited(rng, n, 2)]
        signed = N.signatures([N.weighted_set(t.encode()) for t in texts])
        keys, low = N.bucket_keys(signed), (signed & np.uint64(255)).astype(np.uint8)
        keys[:, 0] = g
        blocks = 2 if g % 2 else 1
        rows += [(g, 0, blocks - 1, at % blocks, b"%d-%d" % (g, at), b"%d-%d" % (g, at), keys[at].tolist(), low[at].tobytes(), t) for at, t in enumerate(texts)]
    schema = pa.schema([("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("node", pa.binary()), ("root", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary()), ("text", pa.string())])
    members = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    want = set()
    for g in {r[0] for r in rows}:
        group = [r for r in rows if r[0] == g]
        want |= {frozenset((a[4], b[4])) for a in group for b in group if a[4] < b[4] and (g % 2 == 0 or a[3] != b[3]) and N.similarity(N.weighted_set(a[8].encode()), N.weighted_set(b[8].encode())) >= N.SIMILARITY}

    def classes(pairs):
        least = {r[4]: r[4] for r in rows}
        for _ in rows:
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        return least

    for size in (1, 7, 1000):
        del trims[:]
        found = [pair for batch in N.block_links(iter(members.to_batches(max_chunksize=size))) for pair in zip(*(c.to_pylist() for c in batch.columns))]
        assert {frozenset(p) for p in found} <= want and classes(found) == classes([tuple(w) for w in want])
        assert len(trims) == 1
        named = [n for batch in N.block_members(iter(members.to_batches(max_chunksize=size))) for n in batch.column("node").to_pylist()]
        assert set().union(*want) <= set(named) and len(named) == len(set(named))


def test_unsettled_members_are_made_once_for_the_same_classes(spark, monkeypatch):
    made, keep = [], N.Scratch.keep
    monkeypatch.setattr(N.Scratch, "keep", lambda self, df, name: made.append(name) or keep(self, df, name))
    rows = edited(random.Random(5), 40, 30)  # they share buckets, but a round soon finds no more links
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), exact=True) == brute(rows)
    assert made.count("unsettled") <= made.count("roots")


def tasks_of(spark, run):
    """Tasks of a run with 16 partitions behind each shuffle and no joins that Spark itself makes broadcasts."""
    context, group = spark.sparkContext, f"tasks-{random.random()}"
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    context.setJobGroup(group, group)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        run()
        status = context.statusTracker()
        infos = [status.getStageInfo(k) for job in status.getJobIdsForGroup(group) for k in status.getJobInfo(job).stageIds]
        return sum(i.numCompletedTasks for i in infos if i)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_tables_take_few_tasks(spark):
    """Each shuffle costs as many tasks as there are partitions, however few rows it has."""
    rows = [(100 * g + i, text) for g in range(8) for i, text in edited(random.Random(g), 12, 4)]
    df, result = spark.createDataFrame(rows, "doc_id long, text string"), []
    assert tasks_of(spark, lambda: result.extend(got(df, exact=True))) < 1050
    assert result == brute(rows)


def test_components_are_those_of_union_find(spark, tmp_path, monkeypatch):
    """Also joined by shuffles, with edges given twice, long paths and a greatest node that all others meet."""
    rng, edges = random.Random(2), [(99_999, i) for i in range(40)]
    path = rng.sample(range(1000, 1200), 200)
    edges += list(zip(path, path[1:])) + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(250)]
    edges += edges[::7]
    least = {n: n for e in edges for n in e}
    for _ in least:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    df = spark.createDataFrame(edges, "u long, v long")
    for most in (N.BROADCAST_NODES, 0):
        monkeypatch.setattr(N, "BROADCAST_NODES", most)
        found = [tuple(r) for r in N.components(df, Scratch(spark, "components")).collect()]
        assert sorted(found) == sorted((n, root) for n, root in least.items() if n != root)


def test_tables_too_large_to_broadcast_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = edited(random.Random(11), 40, 3) + [(100 + i, t) for i, t in edited(random.Random(12), 10, 2)] + [(200, None), (201, "a b"), (202, "a b")]
    df, results = spark.createDataFrame(rows, "doc_id long, text string"), []
    for most in (N.BROADCAST_NODES, 0):
        monkeypatch.setattr(N, "BROADCAST_NODES", most)
        results.append(sorted(map(tuple, N.near_duplicates(df, exact=True).collect())))
    assert results[0] == results[1] and [(r[0], r[1]) for r in results[0]] == brute(rows)


def test_worker_searches_its_imports_once():
    trim()
    assert gc.get_freeze_count()
    gc.unfreeze()


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    words = [b"w%d" % i for i in range(400)]
    a = N.weighted_set(b" ".join(words))
    edited = list(words)
    for i in rng.integers(0, 400, 12):
        edited[i] = b"e%d" % i
    b = N.weighted_set(b" ".join(edited + edited[:50]))
    exact = N.similarity(a, b)
    m = 4000
    s = N.signatures([a, b], m)
    assert abs((s[0] == s[1]).mean() - exact) < 4 * np.sqrt(0.25 / m)


def test_similarity_formula():
    x, y = {1: 1.0, 2: 3.0, 4: 2.0}, {1: 2.0, 2: 1.0, 5: 1.0}
    keys = set(x) | set(y)
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in set(x) & set(y))
    pack = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
    assert abs(N.similarity(pack(x), pack(y)) - want) < 1e-12
