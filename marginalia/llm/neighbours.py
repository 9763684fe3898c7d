"""Approximate nearest neighbours by cosine: stable projections to a few dimensions, indexed by kd-trees.

Vectors are scaled to length 1, so near by cosine is near by distance, and projected with PROJECTIONS Gaussian directions. A squared projected
distance over the squared true one has a chi-square distribution, so a query takes projected neighbours in ascending order, verifies
each against the original vectors, and stops as soon as any vector nearer than its worst result would, with a probability of CONFIDENCE,
have come up already.

The index has two levels. A kd-tree over a sample of projections (about SAMPLE rows, by a hash) cuts space into cells; every vector
lies in one cell, and cells beyond CELL_BYTES are cut into blocks by a hash. A block has a kd-tree of its own, built in the task
that searches it. A query first searches its own cell; what it finds bounds the cells, by their boxes, that can still hold a
nearer one, and these are searched in a second round. Equal vectors are one entry with its least ids, however many rows there are:
none of the others can be among the nearest.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part;
vectors of different lengths are no neighbours of each other; rows equal in id and vector are one row; a query's own id is never its neighbour; of equal scores
the lesser id comes first; with fewer candidates all are given; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

NEAREST, QUERY_STEP = 5, 50
PROJECTIONS, SEED = 8, 11
#: Probability with which a nearer vector would have come up before a search stops.
CONFIDENCE = 0.98
#: Rows that the cells' tree is fitted on, rows of them for each cell at least, and bytes of vectors in a block.
SAMPLE, CELL_SAMPLE, CELL_BYTES = 50_000, 8, 4 << 20
#: Points in a leaf of a block's tree, points verified at once, and queries that meet a block in one task.
LEAF, VERIFIED, QUERY_ROWS = 128, 128, 4096
#: Rows of a batch of queries dealt out to cells.
REACHED = 4096
#: Squared distances below this are rounding errors.
TINY = 1e-12
ENTRIES = "k1 long, k2 long, ids array<long>, vector binary, projected array<float>"


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return high


def directions(length: int) -> np.ndarray:
    """The same Gaussian directions for all vectors of a length."""
    return np.random.default_rng([SEED, length]).standard_normal((length, PROJECTIONS))


def balanced(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which changes no cosine, so that squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


class KdTree:
    """Points cut at the median of their widest dimension down to leaves of at most `leaf` points; each node has its box."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.order = points, np.arange(len(points))
        self.boxes: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.cut: list[tuple[int, float] | None] = []
        self.span: list[tuple[int, int]] = []
        todo = [(self._node(0, len(points)), leaf)] if len(points) else []
        while todo:
            node, leaf = todo.pop()
            a, b = self.span[node]
            low, high = self.boxes[node]
            if b - a <= leaf or not (high > low).any():
                continue
            dimension = int(np.argmax(high - low))
            own = self.order[a:b]
            values = points[own, dimension]
            at = (b - a) // 2
            own[:] = own[np.argpartition(values, at)]
            value = points[own[at], dimension]
            at = int((points[own, dimension] < value).sum())  # equal values go to one side
            if at == 0:
                value = np.min(values[values > value]) if (values > value).any() else value
                at = int((values < value).sum())
            own[:] = own[np.argsort(points[own, dimension] >= value, kind="stable")]
            left, right = self._node(a, a + at), self._node(a + at, b)
            self.children[node], self.cut[node] = (left, right), (dimension, float(value))
            todo += [(left, leaf), (right, leaf)]

    def _node(self, a: int, b: int) -> int:
        own = self.points[self.order[a:b]]
        self.boxes.append(np.stack([own.min(axis=0), own.max(axis=0)]))
        self.children.append(None)
        self.cut.append(None)
        self.span.append((a, b))
        return len(self.boxes) - 1

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf node that each of other points falls into, by the cuts."""
        at = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))] if self.boxes else []
        while todo:
            node, own = todo.pop()
            if self.children[node] is None:
                at[own] = node
                continue
            dimension, value = self.cut[node]
            right = points[own, dimension] >= value
            todo += [(self.children[node][0], own[~right]), (self.children[node][1], own[right])]
        return at

    def ascending(self, query: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Squared distances and places of all points, nearest first, in portions: a portion is given as soon as no node left can hold a nearer one."""
        box = lambda node: float((np.maximum(np.maximum(self.boxes[node][0] - query, query - self.boxes[node][1]), 0) ** 2).sum())
        heap = [(box(0), 0)] if self.boxes else []
        waiting, places = np.empty(0), np.empty(0, np.int64)
        while heap:
            _, node = heapq.heappop(heap)
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(heap, (box(child), child))
                continue
            own = self.order[slice(*self.span[node])]
            waiting, places = np.concatenate([waiting, ((self.points[own] - query) ** 2).sum(axis=1)]), np.concatenate([places, own])
            ready = waiting <= (heap[0][0] if heap else math.inf)
            if ready.any():
                order = np.argsort(waiting[ready], kind="stable")
                yield waiting[ready][order], places[ready][order]
                waiting, places = waiting[~ready], places[~ready]


class Best:
    """The `n` best entries by score, ties by least id."""

    def __init__(self, n: int, bound: float):
        self.n, self.bound = n, bound
        self.scores, self.first, self.places = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, first: np.ndarray, places: np.ndarray) -> None:
        scores, first, places = np.concatenate([self.scores, scores]), np.concatenate([self.first, first]), np.concatenate([self.places, places])
        keep = np.lexsort((first, -scores))[: self.n]
        self.scores, self.first, self.places = scores[keep], first[keep], places[keep]

    def distance(self) -> float:
        """The squared distance of the worst of n, or the bound known from elsewhere if that is less."""
        own = max(2 - 2 * self.scores[-1], TINY) if len(self.scores) == self.n else math.inf
        return min(own, self.bound)


def floats(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """Rows of a binary column of equal sizes."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1).astype(np.float64)


def entries_batches(dtype: str):
    """A mapInArrow function: (k1, k2, ids, embedding) -> ENTRIES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            vectors = [flat[a:b].tobytes() for a, b in zip(starts, starts[1:])]
            projected = np.zeros((len(sizes), PROJECTIONS), np.float32)
            for length in np.unique(sizes):
                own = np.flatnonzero(sizes == length)
                rows = balanced(np.stack([flat[starts[i] : starts[i + 1]] for i in own]).astype(np.float64))
                projected[own] = rows / lengths(rows)[:, None] @ directions(int(length))
            places = pa.ListArray.from_arrays(np.arange(0, projected.size + 1, PROJECTIONS, dtype=np.int32), pa.array(projected.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("ids"), pa.array(vectors, pa.binary()), places], names=["k1", "k2", "ids", "vector", "projected"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, k1, k2 (128 bits of the vector) of the rows that take part."""
    kind = dict(vectors.dtypes)["embedding"]
    item = "float" if kind == "array<float>" else "double"
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast(f"array<{item}>"), lambda x: F.when(x == 0, F.lit(0).cast(item)).otherwise(x)).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return plain.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit("second"), "embedding")})


def entries(rows: DataFrame, n: int) -> DataFrame:
    """ENTRIES of usable rows: a row for each distinct vector, with its n least ids."""
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))  # with its filter a limit before and after the shuffle
    ids = rows.select("k1", "k2", "vec_id").distinct().withColumn("place", place).filter(F.col("place") <= n).groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = rows.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"))
    dtype = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    return vectors.join(ids, ["k1", "k2"]).select("k1", "k2", "ids", "embedding").mapInArrow(entries_batches(dtype), ENTRIES)


class Cells:
    """The upper index: a kd-tree of a sample for each length of vectors; cells are numbered over all of them."""

    def __init__(self, sample: list[tuple[int, list[float]]], counts: dict[int, int], item_bytes: int):
        self.trees, self.first, self.most, at = {}, {}, {}, 0
        for size, n in sorted(counts.items()):
            points = np.array([p for s, p in sample if s == size], np.float64).reshape(-1, PROJECTIONS)
            self.most[size] = max(1, CELL_BYTES // (size // item_bytes * 8))
            wanted = max(1, -(-n // self.most[size]))
            self.trees[size] = KdTree(points, max(CELL_SAMPLE, -(-len(points) // wanted)))
            self.first[size] = at
            at += max(1, len(self.trees[size].boxes))
            self.trees[size].points = self.trees[size].order = None  # the cuts are all that travels

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds `cell` to entries."""
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("vector").to_pylist()], np.int64)
            points = batch.column("projected").flatten().to_numpy().astype(np.float64).reshape(-1, PROJECTIONS)
            cell = np.zeros(len(sizes), np.int32)
            for size in np.unique(sizes):
                own = sizes == size
                cell[own] = self.first[int(size)] + self.trees[int(size)].leaf_of(points[own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])


def reachable(boxes: dict[int, tuple[int, np.ndarray]], factor: float):
    """A mapInArrow function: queries with a home cell and a bound -> a row for each other cell that may hold a nearer vector."""
    cells = np.array(sorted(boxes), np.int32)
    sizes = np.array([boxes[c][0] for c in cells.tolist()])
    low, high = (np.stack([boxes[c][1][i] for c in cells.tolist()]) if len(cells) else np.empty((0, PROJECTIONS)) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("projected").flatten().to_numpy().astype(np.float64).reshape(-1, PROJECTIONS)
            at, place = batch.schema.get_field_index("cell"), 0
            rows, reached = [], []
            for i, (point, home, bound, vector) in enumerate(zip(points, batch.column("cell").to_pylist(), batch.column("bound").to_pylist(), batch.column("vector").to_pylist())):
                apart = (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(axis=1)
                found = cells[(apart <= factor * bound) & (cells != home) & (sizes == len(vector))]
                rows.append(np.full(len(found), i))
                reached.append(found)
                place += len(found)
                if place >= REACHED or i == batch.num_rows - 1:
                    yield batch.take(pa.array(np.concatenate(rows))).set_column(at, "cell", pa.array(np.concatenate(reached)))
                    rows, reached, place = [], [], 0

    return run


FOUND = "k1 long, k2 long, score double, ids array<long>"


def search(dtype: str, n: int, factor: float):
    """A cogrouped applyInArrow function: a block's entries and the queries that search it -> FOUND."""

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if block.num_rows and queries.num_rows:
            vectors, asked = (balanced(floats(t["vector"], dtype)) for t in (block, queries))
            points, places = (np.array(t["projected"].to_pylist(), np.float64) for t in (block, queries))
            sizes, ids = lengths(vectors), block["ids"].to_pylist()
            first = np.array([x[0] for x in ids], np.int64)
            tree = KdTree(points, LEAF)
            for k1, k2, bound, q, length, place in zip(queries["k1"].to_pylist(), queries["k2"].to_pylist(), queries["bound"].to_pylist(), asked, lengths(asked), places):
                best = Best(n, math.inf if bound is None else bound)
                for apart, near in tree.ascending(place):
                    for at in range(0, len(near), VERIFIED):
                        if apart[at] > factor * best.distance():
                            break
                        own = near[at : at + VERIFIED]
                        best.add((vectors[own] * q).sum(axis=1) / (sizes[own] * length), first[own], own)
                    if apart[-1] > factor * best.distance():
                        break
                for column, values in zip(out, ([k1] * len(best.places), [k2] * len(best.places), best.scores.tolist(), [ids[i] for i in best.places.tolist()])):
                    column += values
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.list_(pa.int64()))], names=["k1", "k2", "score", "ids"])

    return run


def searched(points: DataFrame, requests: DataFrame, blocks: DataFrame, run) -> DataFrame:
    """FOUND of requests (k1, k2, vector, projected, bound, cell). blocks (cell, n_blocks) is small. Requests for one block are dealt out by QUERY_ROWS, each part with a copy of the block."""
    inside = points.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod("k2", "n_blocks"))
    asked = requests.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    parts = asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("parts"))
    asked = asked.join(parts, ["cell", "block"]).withColumn("part", F.pmod("k2", "parts"))
    inside = inside.join(parts, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    left = inside.select("cell", "block", "part", "ids", "vector", "projected").groupBy("cell", "block", "part")
    right = asked.select("cell", "block", "part", "k1", "k2", "vector", "projected", "bound").groupBy("cell", "block", "part")
    return left.cogroup(right).applyInArrow(run, FOUND)


def nearest(vectors: DataFrame, asked: Column, n: int = NEAREST, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: the n nearest found of each row of vectors (vec_id, embedding) for which `asked`, a condition on vec_id, holds."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "neighbours")
    factor = quantile(confidence, PROJECTIONS)
    rows = usable(vectors)
    item_bytes, dtype = (4, "<f4") if dict(rows.dtypes)["embedding"] == "array<float>" else (8, "<f8")
    most = n + 1  # entries and ids that a result can be made of, the query's own included
    found = scratch.keep(entries(rows, most), "entries")
    counts = {r[0]: r[1] for r in found.groupBy(F.octet_length("vector").alias("size")).count().collect()}
    share = F.lit(min(1.0, SAMPLE / max(1, sum(counts.values()))))
    sample = [(r[0], r[1]) for r in found.filter(F.pmod("k1", F.lit(1 << 20)) < share * (1 << 20)).select(F.octet_length("vector"), "projected").collect()]
    cells = Cells(sample, counts, item_bytes)
    points = scratch.keep(found.mapInArrow(cells.batches, f"{ENTRIES}, cell int"), "points")
    place = lambda i: F.element_at("projected", i + 1)
    edges = points.groupBy("cell").agg(F.count("*").alias("n"), F.first(F.octet_length("vector")).alias("size"), *[F.min(place(i)).alias(f"a{i}") for i in range(PROJECTIONS)], *[F.max(place(i)).alias(f"b{i}") for i in range(PROJECTIONS)]).collect()
    boxes = {r["cell"]: (r["size"], np.array([[r[f"{side}{i}"] for i in range(PROJECTIONS)] for side in "ab"], np.float64)) for r in edges}
    blocks = spark.createDataFrame([(r["cell"], -(-r["n"] // cells.most[r["size"]])) for r in edges], "cell int, n_blocks long")
    ids = rows.filter(asked)
    requests = scratch.keep(points.join(ids.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "vector", "projected", "cell"), "requests")
    run = search(dtype, most, factor)
    home = scratch.keep(searched(points, requests.withColumn("bound", F.lit(None).cast("double")), blocks, run), "home")
    worst = home.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("score"), False).alias("s")).select("k1", "k2", F.when(F.size("s") >= most, F.greatest(2 - 2 * F.get("s", F.lit(most - 1)), F.lit(TINY))).alias("bound"))
    bounded = requests.join(worst, ["k1", "k2"]).select(*requests.columns, F.coalesce("bound", F.lit(math.inf)).alias("bound"))
    further = searched(points, bounded.mapInArrow(reachable(boxes, factor), bounded.schema), blocks, run)
    every = home.unionByName(further).withColumn("place", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), F.get("ids", F.lit(0))))).filter(F.col("place") <= most)
    lists = every.groupBy("k1", "k2").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    named = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("far"), i.alias("vec_id")))))
    own = ids.select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct().join(lists.select("k1", "k2", named.alias("named")), ["k1", "k2"])
    ranked = own.select("query_id", F.posexplode(F.slice(F.array_sort(F.filter("named", lambda x: x["vec_id"] != F.col("query_id"))), 1, n)).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
