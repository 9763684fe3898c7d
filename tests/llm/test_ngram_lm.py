"""The language model against dictionaries of counts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import elias_fano, ngram_lm as M
from marginalia.llm.common import table


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (5, 1 << 64), (1000, 5000), (20000, 1 << 64), (64, 64), (3000, 1 << 44)])
def test_elias_fano_search(n, universe):
    rng = np.random.default_rng(n)
    draw = lambda k: rng.integers(0, universe - 1, k, dtype=np.uint64, endpoint=True)
    values = np.unique(draw(n))
    coded = elias_fano.EliasFano(elias_fano.build(values, universe))
    assert (coded.values() == values).all()
    queries = np.concatenate([values, draw(500)])
    at = {int(v): i for i, v in enumerate(values)}
    assert coded.search(queries).tolist() == [at.get(int(q), -1) for q in queries]
    assert (coded.access(np.arange(len(values))) == values).all()
    repeated = np.sort(np.concatenate([values, values[: n // 2]]))
    assert (elias_fano.EliasFano(elias_fano.build(repeated, universe)).access(np.arange(len(repeated))) == repeated).all()


def brute(rows):
    tokens = lambda t: [*(bytes(w) for w in (t or "").encode().lower().split()), "end"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c, n, after, kinds = Counter(), Counter(), Counter(), Counter()
    grams = lambda words: [(*(["before", *words][i - 1 : i + 1] if i else ["before"]), w) for i, w in enumerate(words)]
    for d, t in rows:
        if not held(d):
            words = tokens(t)
            c.update(words)
            n.update(zip(["before", *words], words))
            n.update(g for g in grams(words) if len(g) == 3)
    for (*context, _), k in n.items():
        after[tuple(context)] += k
        kinds[tuple(context)] += 1
    total, size = sum(c.values()), len(c)

    def p(gram):
        if len(gram) == 1:
            return (c[gram[0]] + 0.5) / (total + 0.5 * (size + 1))
        context, lower = gram[:-1], p(gram[1:])
        return max(n[gram] - M.DISCOUNT, 0) / after[context] + M.DISCOUNT * kinds[context] / after[context] * lower if after[context] else lower

    out = []
    for d, t in rows:
        words = tokens(t)
        out.append((d, held(d), len(words), sum(c[w] > 0 for w in words), total, sum(math.log10(p((w,))) for w in words), sum(math.log10(p(g)) for g in grams(words))))
    return out


def check(df, rows):
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    got, want = sorted((tuple(r) for r in M.score_documents(df).collect()), key=key), sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= 0.018 * w[2] + 1e-6  # half a step of the quantiser for each token
    return got


def test_whole_small_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(M, "SHARD_CHARS", 100_000)
    docs = table(spark, sf_dir, "documents")
    got = check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "The the THE cat"), (3, "The the THE cat"), (None, "the cat sat"), (4, "x " * 50000), (5, "É é the"), (6, "unseen words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as block", "true as held_out")
    check(df, rows)
    assert M.score_documents(df.limit(0)).count() == 0
    assert [r["train_tokens"] for r in M.score_documents(df.filter("doc_id = 6")).collect()] in ([0], [4])


def test_blocks_and_opened_files_follow_the_tokens(tmp_path):
    """With 1,000 shards, five tokens touch six shards at most, and a file is opened once."""
    tokens = M.Tokens()
    tokens.add([b"one two three four"])
    blocks = list(M.count_blocks(tokens, 1000))
    assert len(blocks) <= 6 and sum(len(b) for _, b in blocks) < 6 * 300
    for s in range(1000):
        M.write_file(f"file:{tmp_path}/m/shard-{s:06d}", M.pack(M.build_shard([M.unpack(np.frombuffer(b, np.uint8), M.BLOCK) for k, b in blocks if k == s] or [M.unpack(np.frombuffer(M.pack({k: [] for k in M.BLOCK}, M.BLOCK), np.uint8), M.BLOCK)]), M.TRIE))
    model, before = M.Model(f"file:{tmp_path}/m", 1000, 5, 5), M.OpenShards.OPENED
    first, again = model.score(tokens), model.score(tokens)
    assert M.OpenShards.OPENED - before == len(blocks) and (first[3] == again[3]).all() and first[1].tolist() == [5]


def test_documents_that_occur_in_training_score_higher(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    held = [t for d, t in docs if zlib.crc32(str(d).encode()) % 5 == 1 and len(t) > 300][:20]
    rows = docs + [(10**6 + k, t) for k, t in enumerate(held) if zlib.crc32(str(10**6 + k).encode()) % 5 != 1]
    twice = {t for d, t in rows[len(docs) :]}
    score = lambda rows: {r["doc_id"]: r["score"] / r["n_tokens"] for r in M.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alone, with_copy = score(docs), score(rows)
    gains = [with_copy[d] - alone[d] for d, t in docs if t in twice and zlib.crc32(str(d).encode()) % 5 == 1]
    assert len(gains) > 5 and np.median(gains) > 0.5  # some had copies in training before
