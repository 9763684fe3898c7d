"""Benchmark decontamination by q-gram filtering in diagonal bands.

Texts are compared lower-cased with white space runs as one space. An item of m
characters with at most e = floor(`EDIT_RATE` * m) edits inside a text shares at least
m - Q + 1 - Q * e of its q-grams with it (the q-gram lemma), all on diagonals
(place in the text less place in the item) that lie within e of each other. Diagonals
fall into overlapping bands of 2(e + 1), a new one every e + 1, so one band holds all of them.
A band with enough shared q-grams is a region; regions are verified by a semi-global alignment
inside the band, first to last until one matches without an edit. Texts are scanned whole, by vector operations, once for each
block of the benchmark; a block has `BLOCK_CHARS` characters on average or one item, which bounds what is
broadcast, whatever the benchmark's size. Shared q-grams are counted `POSTINGS` at a time, so a text of one
repeated character takes no more memory than another.

Defined results: one row for each document row and item that it leaks. Null or
empty texts and items leak nothing; items of less than `LEAST_CHARS` normalised
characters are too short to tell a leak and are skipped; repeated documents and items are each
reported; ties take the first place; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, kept_table, new_path, slices, table, texts_of, trim

Q, EDIT_RATE, LEAST_CHARS = 10, 0.07, 32
#: Characters of the benchmark in one index.
BLOCK_CHARS = 1_000_000
#: Shared q-grams that are counted in one go.
POSTINGS = 1_000_000
TABLE_BITS = 22
#: Bits of a band's number and of an item's in a key; a document's have the rest (a slice has SLICE_ROWS = 2^13 rows at most).
BAND_BITS, ITEM_BITS = 32, 18
FOUND = "doc_id long, item_id long, edits int, start long"


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """32 bits for each window of Q = 2 + 8 characters, by doubling."""
    h, size, parts = c, 1, {}
    while size <= Q:
        parts[size] = h
        if 2 * size <= len(c):
            h = h[: len(c) - 2 * size + 1] * np.uint32(0x9E3779B1) + h[size:] * np.uint32(0x85EBCA77)
            h = h ^ (h >> np.uint32(15))
        size *= 2
    n, at, out = len(c) - Q + 1, 0, np.zeros(max(0, len(c) - Q + 1), np.uint32)
    if n > 0:
        for size in sorted(parts, reverse=True):
            if Q & size:
                out = out * np.uint32(0xC2B2AE3D) + parts[size][at : at + n]
                at += size
    return out


def semi_global(item: np.ndarray, text: np.ndarray, low: int, high: int, limit: int) -> tuple[int, int]:
    """Fewest edits of item against a part of text on diagonals low to high, and that part's start; limit + 1 if above it.

    A row holds the edits up to each diagonal, and where the part starts.
    """
    width, far = high - low + 1, 1 << 20
    k = np.arange(width)
    place = low + k
    cost = np.where((place >= 0) & (place <= len(text)), 0, far).astype(np.int64)
    # start and cost in one number, so that a minimum carries the start along
    packed = cost * (1 << 32) + np.maximum(place, 0)
    one = np.int64(1 << 32)
    padded = np.concatenate([text, np.zeros(1, text.dtype)])
    for i in range(len(item)):
        at = place + i
        inside = (at >= 0) & (at < len(text))
        same = padded[np.where(inside, at, len(text))] == item[i]
        step = np.where(inside, packed + np.where(same, 0, one), far * one)
        step[:-1] = np.minimum(step[:-1], packed[1:] + one)  # a character of the item is missing in the text
        end = place + i + 1
        valid = (end >= 0) & (end <= len(text))
        step = np.where(valid, step, far * one)
        packed = np.minimum.accumulate(step - k * one) + k * one  # characters added in the text
        packed = np.where(valid, packed, far * one)
        if (packed >> 32).min() > limit:
            return limit + 1, -1
    best = int(packed.min())
    return min(best >> 32, limit + 1), best & 0xFFFFFFFF


class Index:
    """Q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        normal = sorted(((i, normalise(t or "")) for i, t in items), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.items = [(i, codes(t)) for i, t in normal if len(t) >= LEAST_CHARS]
        if len(self.items) >> ITEM_BITS:
            raise ValueError("a block of the benchmark has too many items")
        self.edits = np.asarray([int(EDIT_RATE * len(c)) for _, c in self.items], np.int64)
        self.longest = max((len(c) + e + 2 for (_, c), e in zip(self.items, self.edits.tolist())), default=0)  # no band is negative
        self.least = np.asarray([len(c) - Q + 1 - Q * e for (_, c), e in zip(self.items, self.edits)], np.int64)
        hashes = [gram_hashes(c) for _, c in self.items]
        sizes = [len(h) for h in hashes]
        grams = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
        order = np.argsort(grams, kind="stable")
        self.item = np.repeat(np.arange(len(hashes)), sizes)[order]
        self.place = (np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, np.int64))[order]
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.grams >> np.uint32(32 - TABLE_BITS)] = True

    def regions(self, text: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, lowest and highest diagonal) of bands with enough q-grams; starts: where documents begin."""
        h = gram_hashes(text)
        at = np.flatnonzero(self.table[h >> np.uint32(32 - TABLE_BITS)])
        if not len(at) or not len(self.grams):
            return []
        gram = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        hit = self.grams[gram] == h[at]
        at, gram = at[hit], gram[hit]
        if not len(at):
            return []
        found, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(self.count[gram])
        cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]), POSTINGS), side="right"))
        for a, b in zip(cuts, [*cuts[1:], len(at)]):
            keys, times = np.unique(self.band_keys(at[a:b], gram[a:b], starts), return_counts=True)
            found, where = np.unique(np.concatenate([found, keys]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n, times]), len(found)).astype(np.int64)
        items = (found >> BAND_BITS) & ((1 << ITEM_BITS) - 1)
        out = []
        for key in found[n >= self.least[items]].tolist():
            i = (key >> BAND_BITS) & ((1 << ITEM_BITS) - 1)
            width = int(self.edits[i]) + 1
            low = (key & ((1 << BAND_BITS) - 1)) * width - self.longest
            out.append((key >> (BAND_BITS + ITEM_BITS), i, low, low + 2 * width - 1))
        return out

    def band_keys(self, at: np.ndarray, gram: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(document, item, band) of both bands that hold the diagonal of each shared q-gram, as one number."""
        count = self.count[gram]
        spread = np.repeat(np.arange(len(at)), count)
        posting = self.first[gram][spread] + np.arange(len(spread)) - np.repeat(np.cumsum(count) - count, count)
        item, diagonal = self.item[posting], at[spread] - self.place[posting]
        doc = np.searchsorted(starts, at, side="right")[spread] - 1
        band = (diagonal + self.longest) // (self.edits[item] + 1)  # its own band and the one before hold the diagonal
        keys = (doc << (BAND_BITS + ITEM_BITS)) | (item << BAND_BITS)
        return np.concatenate([keys | band, keys | (band - 1)])

    def leaks(self, texts: list[str]) -> list[tuple[int, int | None, int, int]]:
        """(document, item id, edits, start) for every leak."""
        arrays = [codes(normalise(t)) for t in texts]
        sizes = np.asarray([len(a) + 1 for a in arrays], np.int64)  # documents are kept apart by a character that no text has
        starts = np.cumsum(sizes) - sizes
        apart = np.asarray([0xFFFFFFFF], np.uint32)
        text = np.concatenate([x for a in arrays for x in (a, apart)]) if arrays else np.zeros(0, np.uint32)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, i, low, high in self.regions(text, starts):
            limit, start = int(self.edits[i]), int(starts[doc])
            if best.get((doc, i), (1, 0))[0] == 0:
                continue  # regions come in order, so none ahead is better
            item, own = self.items[i][1], arrays[doc]
            low, high = low - limit - start, high + limit - start
            # only the part that the band can reach
            left = max(0, low)
            edits, where = semi_global(item, own[left : max(0, high + len(item) + 1)], low - left, high - left, limit)
            if edits <= limit:
                best[doc, i] = min((edits, where + left), best.get((doc, i), (edits, where + left)))
        return [(doc, self.items[i][0], edits, where) for (doc, i), (edits, where) in sorted(best.items())]


def leak_batches(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = index.value.leaks([(t or b"").decode("utf-8", "replace") for t in texts_of(batch, "text")])
                ids = batch.column("doc_id").to_pylist()
                columns = ([ids[d] for d, *_ in found], [i for _, i, _, _ in found], [e for _, _, e, _ in found], [s for *_, s in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "item_id", "edits", "start"])
        trim()

    return run


def clean_batches(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                keep = np.ones(len(batch), bool)
                keep[[d for d, *_ in index.value.leaks([(t or b"").decode("utf-8", "replace") for t in texts_of(batch, "text")])]] = False
                yield batch.filter(pa.array(keep))
        trim()

    return run


def indexes(benchmark: DataFrame) -> list:
    """Broadcast indexes of the benchmark's blocks. The benchmark is read once and dealt out by a hash."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS) or 1
    spark = benchmark.sparkSession
    if blocks == 1:
        return [spark.sparkContext.broadcast(Index([tuple(r) for r in items.collect()]))]
    path = new_path(spark, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(path)
    dealt = spark.read.schema("item_id long, text string, block int").parquet(path)
    return [spark.sparkContext.broadcast(Index([tuple(r) for r in dealt.filter(F.col("block") == b).select("item_id", "text").collect()])) for b in range(blocks)]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start (in the normalised text) for every leak in docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return reduce(DataFrame.unionAll, [rows.mapInArrow(leak_batches(x), FOUND) for x in indexes(benchmark)])


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A table of the rows of docs that leak nothing, with all their columns."""
    with batch_rows(docs.sparkSession):
        return kept_table(reduce(lambda df, x: df.mapInArrow(clean_batches(x), docs.schema), indexes(benchmark), docs), "clean")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
