import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import neighbours as N
from marginalia.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, step, n):
    """Exact answers by the contract's rule."""
    own = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in own:
        if q % step == 0:
            a = np.float32(a).astype(float)
            scored = [(-float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), i) for i, v in own if i != q and len(v) == len(a) for b in [np.float32(v).astype(float)]]
            out[q] = sorted(scored)[:n]
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got[q]} & {i for _, i in x}) for q, x in want.items())
    return hits / max(1, sum(map(len, want.values())))


def test_chi_square_against_counts():
    draws = (np.random.default_rng(1).standard_normal((200_000, N.PROJECTIONS)) ** 2).sum(axis=1)
    for p in (0.1, 0.5, 0.9, 0.98):
        assert abs((draws <= N.quantile(p, N.PROJECTIONS)).mean() - p) < 0.005


@pytest.mark.parametrize("points", [np.random.default_rng(2).standard_normal((3000, 3)), np.zeros((500, 3)), np.repeat(np.arange(4.0), 300).reshape(-1, 3), np.empty((0, 3)), np.ones((1, 3))])
def test_tree_gives_every_point_in_order(points):
    tree, query = N.KdTree(points, 16), np.array([0.3, -0.2, 1.0])
    found = list(tree.ascending(query))
    apart = np.concatenate([d for d, _ in found]) if found else np.empty(0)
    assert (np.diff(apart) >= 0).all() and sorted(np.concatenate([i for _, i in found]).tolist() if found else []) == list(range(len(points)))
    if len(points):  # a point's leaf by the cuts is the one that holds it
        for node, (a, b) in enumerate(tree.span):
            if tree.children[node] is None:
                assert (tree.leaf_of(points[tree.order[a:b]]) == node).all()


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").collect()]
    got, want = answers(N.op11_nearest_neighbours(spark, sf_dir)), brute(rows, 50, 5)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    exact = {(q, i): -s for q, x in brute(rows, 50, 10**9).items() for s, i in x}
    for q, x in got.items():
        assert len(x) == 5 and x == sorted(x, key=lambda y: (-y[1], y[0])) and all(abs(exact[q, i] - s) < 1e-12 for i, s in x)


def test_many_cells_blocks_and_parts(spark, monkeypatch):
    """Clusters of several sizes over many small cells, some cut into blocks, and queries in parts."""
    monkeypatch.setattr(N, "CELL_BYTES", 100 * 24 * 8)
    monkeypatch.setattr(N, "SAMPLE", 60)
    monkeypatch.setattr(N, "CELL_SAMPLE", 20)
    monkeypatch.setattr(N, "QUERY_ROWS", 10)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((5, 24))
    rows = [(i, (centre[i % 5] + rng.standard_normal(24) * (0.02 if i % 3 else 0.6)).astype(np.float32).tolist(), 0) for i in range(1500)]
    got, want = answers(N.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)), brute(rows, 10, 5)
    assert set(got) == set(want) and recall(got, want) >= 0.95


def test_odd_rows(spark):
    a, b, c = [1.0, 0.0, 2.0], [0.0, 1.0, 1.0], [-1.0, 0.5, 0.0]
    rows = [(i, a, 0) for i in range(0, 200)] + [(50, a, 1), (50, a, 0)] + [(300 + i, [x * 2 for x in a], 0) for i in range(8)]
    rows += [(400, b, 0), (401, c, 0), (450, None, 0), (500, [], 0), (550, [0.0, 0.0, -0.0], 0), (600, [1.0, None, 0.0], 0), (650, [1.0, float("nan"), 0.0], 0), (700, [float("inf"), 1.0, 0.0], 0), (None, a, 0), (750, [1.0, 2.0], 0), (800, [3.0, 1.0], 0), (850, [-0.0, 1.0, 1.0], 0), (900, [1e30, 0.0, 1e30], 0), (950, [1e-40, 0.0, 1e-40], 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit("clash") for x in ("k1", "cell", "rank", "score", "query_id", "ids")})
    got, want = answers(N.nearest(docs, F.col("vec_id") % 50 == 0)), brute(rows, 50, 5)
    assert set(got) == set(want)
    for q, x in want.items():
        assert np.allclose([-s for s, _ in x], [s for _, s in got[q]], atol=1e-12)
    assert [i for i, _ in got[0]][:3] == [1, 2, 3] and [i for i, _ in got[50]][:3] == [0, 1, 2] and [i for i, _ in got[750]] == [800]
    assert [i for i, _ in got[400]][:1] == [850] and {i for i, _ in got[900]} >= {950}


def test_a_hot_vector_is_one_entry(spark):
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.rand(1), F.lit(1.0))).cast("array<float>").alias("embedding"))
    kept = N.entries(N.usable(rows), 6)
    hot = [r["ids"] for r in kept.collect() if len(r["ids"]) > 1]
    assert hot == [[1, 2, 4, 5, 7, 8]]
    got = answers(N.nearest(rows, F.col("vec_id") % 50 == 0))
    assert len(got) == 60 and [i for i, _ in got[50]] == [1, 2, 4, 5, 7]


def test_empty_and_single(spark):
    assert N.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    assert N.nearest(spark.createDataFrame([(0, [1.0, 2.0], 1)], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
