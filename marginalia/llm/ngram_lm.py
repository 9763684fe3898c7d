"""N-gram language model in Elias-Fano tries, learnt from the corpus and queried where texts are read.

Tokens are words with A-Z lower-cased, then one end for each text. The model interpolates trigrams, bigrams
and add-half unigrams by absolute discounting: p(w|uv) = max(c(uvw) - D, 0) / c(uv.) + D T(uv) / c(uv.) p(w|v), with c(uv.) the
trigrams and T(uv) the distinct words after uv, and so on down to p(w).

Counting: every task counts its own words, pairs and triples by vector operations and sends each shard (by a hash of the
first word) that they touch a compact block; a shard's task merges its blocks and writes one file. A file holds a trie of three
levels. Level 1: the words' 64-bit hashes (Elias-Fano), counts, quantised back-off weights and monotone pointers
(Elias-Fano) to their successors. Level 2: each word's successors as sorted 40-bit hashes, with a discounted probability and a back-off
weight, both quantised to 8 bits on a log scale, and monotone pointers to level 3: each pair's successors as sorted 32-bit hashes with
quantised probabilities. A query finds the context in level 1 and then, level by level, searches the successor
in the range that two neighbouring pointers give. Two successors of one context with equal hash bits count as one: of k
successors, a word that never followed is taken for one of them with probability k / 2^40 (k / 2^32 in level 3).

Files lie in the shared folder and are memory-mapped (a folder that can't be mapped is read through
its file system). The number of shards follows the corpus, a task sends and opens only those that its
words fall in, and what it holds is bounded by `FLUSH_TOKENS`, a shard's size and `OPEN_BYTES`. Each flush's words, pairs and triples are looked
up once for each distinct one. No table grows on the driver: it gets each shard's totals.

Defined results: a null or empty text is its end alone; a document whose id is null is a training document; repeated rows
count as often as they occur; without training rows all counts are 0; an empty table gives an empty table; other
columns are ignored; texts of any length are scored whole.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elias_fano
from .common import doc_mod, held, new_path, slices, table, texts_of, trim, word_hashes

DISCOUNT = 0.75
#: Hashes of the end and of what stands before the first word; no word has white space.
END, BEFORE = (np.uint64(int(x)) for x in (0x8F3B_11D0_77A1_5E01, 0x3C6E_F372_FE94_F82B))
#: Tokens that a task holds before it sends or looks up what it has; characters of the corpus for each shard.
FLUSH_TOKENS, SHARD_CHARS = 1_300_000, 12_000_000
#: Bits of a successor in level 2 and in level 3, and the log10 range of a quantised probability.
PAIR_BITS, TRIPLE_BITS, LOG_RANGE = 40, 32, 9.0
#: Of the files that a worker keeps open: their number, and their bytes if they can't be mapped.
OPEN_FILES, OPEN_BYTES = 1000, 256 << 20
HELD_OUT_OF, HELD_OUT = 5, 1


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-30)) * (255 / LOG_RANGE)), 0, 255).astype(np.uint8)


PROBABILITY = 10.0 ** (-np.arange(256) * LOG_RANGE / 255)


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


class Tokens:
    """Texts' tokens and what stands before each."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.total = 0

    def add(self, texts: list[bytes | None]) -> None:
        for text in texts:
            words = word_hashes((text or b"").lower())
            self.parts += [words, np.asarray([END])]
            self.sizes.append(len(words) + 1)
            self.total += len(words) + 1

    def distinct(self) -> "Grams":
        return Grams(np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64), np.asarray(self.sizes, np.int64))


class Grams:
    """Distinct words (hashes), pairs (context, word) and triples (pair, word) of texts as numbers of what they consist of, and those of each token."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray):
        self.starts = np.cumsum(sizes) - sizes
        self.words, at = np.unique(np.concatenate([tokens, np.asarray([BEFORE])]), return_inverse=True)
        self.at, n = at[:-1], len(self.words)
        before = np.empty(len(tokens), np.int64)
        before[1:] = self.at[:-1] if len(tokens) else 0
        before[self.starts] = at[-1]
        pairs, self.pair_at = np.unique(before * n + self.at, return_inverse=True)
        self.context, self.word = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
        del before, pairs, at
        inner = np.ones(len(tokens), bool)
        inner[self.starts] = False  # a text's first token has no word before its context
        self.inner = np.flatnonzero(inner)
        triples, first, self.triple_at = np.unique(self.pair_at[self.inner - 1] * n + self.at[self.inner], return_index=True, return_inverse=True)
        self.head, self.last = (triples // n).astype(np.int32), (triples % n).astype(np.int32)
        self.tail = self.pair_at[self.inner[first]].astype(np.int32)  # the pair of a triple's last two
        self.at, self.pair_at, self.triple_at, self.inner = (x.astype(np.int32) for x in (self.at, self.pair_at, self.triple_at, self.inner))

    def shards(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Each shard that has words, with its words, pairs and triples in order."""
        shard = shard_of(self.words, n)
        own = (shard, shard[self.context], shard[self.context[self.head]])
        orders = [np.argsort(x, kind="stable") for x in own]
        present = np.unique(shard)
        edges = [(np.searchsorted(x[o], present), np.searchsorted(x[o], present, side="right")) for x, o in zip(own, orders)]
        for k, s in enumerate(present.tolist()):
            yield s, *(o[a[k] : b[k]] for o, (a, b) in zip(orders, edges))


# ------------------------------------------------------------------ counting
BLOCK = {"words": "<u8", "counts": "<u4", "contexts": "<u8", "sizes": "<u4", "low": "<u4", "high": "u1", "n": "u1", "many": "<u4", "more": "<u4", "kinds": "u1", "wide": "<u4", "wider": "<u4", "last": "<u4", "n3": "u1", "many3": "<u4", "more3": "<u4"}
TRIE = {"count": "<u4", "back1": "u1", "low": "<u4", "high": "u1", "p2": "u1", "back2": "u1", "last": "<u4", "p3": "u1"} | {f"{name}.{k}": kind for name in ("words", "from1", "from2") for k, kind in (("high", "<u8"), ("before", "<u4"), ("ones", "<u4"), ("low", "u1"), ("size", "<i8"))}


def pack(arrays: dict[str, np.ndarray], kinds: dict[str, str]) -> bytes:
    """The lengths of the arrays, then these, each from a multiple of 8 bytes on."""
    parts = [np.asarray([len(arrays[k]) for k in kinds], "<i8").tobytes()]
    for k, kind in kinds.items():
        data = np.ascontiguousarray(arrays[k], dtype=kind).tobytes()
        parts.append(data + b"\0" * (-len(data) % 8))
    return b"".join(parts)


def unpack(data: np.ndarray, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """Views of the arrays in bytes."""
    sizes, at, out = data[: 8 * len(kinds)].view("<i8"), 8 * len(kinds), {}
    for n, (k, kind) in zip(sizes.tolist(), kinds.items()):
        size = n * np.dtype(kind).itemsize
        out[k] = data[at : at + size].view(kind)
        at += size + -size % 8
    return out


def in_bytes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in a byte each, and where greater ones stand and what they are."""
    many = np.flatnonzero(n > 255)
    return np.minimum(n, 255), many, n[many]


def from_bytes(n: np.ndarray, many: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = n.astype(np.int64)
    out[many.astype(np.int64)] = more
    return out


def count_blocks(tokens: Tokens, shards: int) -> Iterator[tuple[int, bytes]]:
    """For each shard that the texts' words fall in, its words', pairs' and triples' counts."""
    g = tokens.distinct()
    count, pair_count, triple_count = np.bincount(g.at, minlength=len(g.words)), np.bincount(g.pair_at, minlength=len(g.context)), np.bincount(g.triple_at, minlength=len(g.head))
    kinds = np.bincount(g.head, minlength=len(g.context))
    for s, w, p, t in g.shards(shards):
        w = w[count[w] > 0]
        own, sizes = np.unique(g.words[g.context[p]], return_counts=True)
        succ = g.words[g.word[p]] >> np.uint64(64 - PAIR_BITS)
        arrays = {"words": g.words[w], "counts": count[w], "contexts": own, "sizes": sizes, "low": succ & np.uint64(0xFFFFFFFF), "high": succ >> np.uint64(32), "last": g.words[g.last[t]] >> np.uint64(64 - TRIPLE_BITS)}
        arrays |= dict(zip(("n", "many", "more", "kinds", "wide", "wider", "n3", "many3", "more3"), (*in_bytes(pair_count[p]), *in_bytes(kinds[p]), *in_bytes(triple_count[t]))))
        yield s, pack(arrays, BLOCK)


def count_batches(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()

        def flush() -> pa.RecordBatch:
            blocks = list(count_blocks(tokens, shards))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in blocks], pa.int64()), pa.array([b for _, b in blocks], pa.binary())], names=["shard", "block"])

        for whole in batches:
            for batch in slices(whole, "text"):
                tokens.add(texts_of(batch, "text"))
                if tokens.total >= FLUSH_TOKENS:
                    yield flush()
                    tokens = Tokens()
                    trim()
        if tokens.total:
            yield flush()
        del tokens
        trim()

    return run


# ------------------------------------------------------------------ building and opening shards
def file_system(path: str):
    """path has its scheme; without one it would be each machine's own disk."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    """Whole or not at all, so that a task that runs again does no harm."""
    system, local = file_system(path)
    system.create_dir(os.path.dirname(local), recursive=True)
    own = f"{local}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, local)


def open_file(path: str) -> np.ndarray:
    system, local = file_system(path)
    if type(system).__name__ == "LocalFileSystem":
        return np.memmap(local, np.uint8, "r")
    with system.open_input_file(local) as source:
        return np.frombuffer(source.read(), np.uint8)


def run_starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their sums, and which of them each key is."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = run_starts(ordered)
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(keys)]])))
    return ordered[first], np.bincount(which, n, len(first)).astype(np.int64), which


def discounted(n: np.ndarray, context: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised probabilities of counts n in order of their contexts, the contexts' back-off weights, and pointers to where each context's begin."""
    total, kinds = np.bincount(context, n, contexts), np.bincount(context, minlength=contexts)
    return quantise((n - DISCOUNT) / total[context]), quantise(DISCOUNT * kinds / np.maximum(total, 1)), np.concatenate([[0], np.cumsum(kinds)]).astype(np.uint64)


def build_shard(blocks: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The trie of a shard from its blocks."""
    join = lambda name: np.concatenate([b[name] for b in blocks])
    wide = lambda *names: np.concatenate([from_bytes(*(b[x] for x in names)) for b in blocks])
    nodes, at = np.unique(np.concatenate([join("words"), join("contexts")]), return_inverse=True)
    n_words = sum(len(b["words"]) for b in blocks)
    count = np.bincount(at[:n_words], join("counts"), len(nodes)).astype(np.int64)
    context = np.repeat(at[n_words:], join("sizes"))
    keys = (context.astype(np.uint64) << np.uint64(PAIR_BITS)) | (join("high").astype(np.uint64) << np.uint64(32)) | join("low").astype(np.uint64)
    keys, n2, which = summed(keys, wide("n", "many", "more"))
    head = np.repeat(which, wide("kinds", "wide", "wider"))
    triples, n3, _ = summed((head.astype(np.uint64) << np.uint64(TRIPLE_BITS)) | join("last").astype(np.uint64), wide("n3", "many3", "more3"))
    p2, back1, from1 = discounted(n2, (keys >> np.uint64(PAIR_BITS)).astype(np.int64), len(nodes))
    p3, back2, from2 = discounted(n3, (triples >> np.uint64(TRIPLE_BITS)).astype(np.int64), len(keys))
    out = {"count": count, "back1": back1, "low": keys & np.uint64(0xFFFFFFFF), "high": (keys >> np.uint64(32)) & np.uint64(0xFF), "p2": p2, "back2": back2, "last": triples & np.uint64(0xFFFFFFFF), "p3": p3}
    for name, values, universe in (("words", nodes, 1 << 64), ("from1", from1, int(from1[-1]) + 1), ("from2", from2, int(from2[-1]) + 1)):
        coded = elias_fano.build(values, universe)
        if coded["before"].dtype != np.uint32:
            raise ValueError("a shard has more entries than its directories can number")
        out |= {f"{name}.{k}": v for k, v in coded.items()}
    return out


def lower_bound(left: np.ndarray, right: np.ndarray, wanted: np.ndarray, value) -> np.ndarray:
    """Where wanted stands among the sorted value(i) of left <= i < right, or -1."""
    end, left, right = right, left.copy(), right.copy()
    active = np.flatnonzero(left < right)
    while len(active):
        middle = (left[active] + right[active]) >> 1
        less = value(middle) < wanted[active]
        left[active[less]] = middle[less] + 1
        right[active[~less]] = middle[~less]
        active = active[left[active] < right[active]]
    found = left < end
    found[found] = value(left[found]) == wanted[found]
    return np.where(found, left, -1)


class Shard:
    """A shard's file: words, their successors, and the successors of these pairs."""

    def __init__(self, data: np.ndarray):
        arrays = unpack(data, TRIE)
        part = lambda name: elias_fano.EliasFano({k.split(".")[1]: v for k, v in arrays.items() if k.startswith(f"{name}.")})
        self.words, self.from1, self.from2 = part("words"), part("from1"), part("from2")
        self.count, self.back1, self.low, self.high, self.p2, self.back2, self.last, self.p3 = (arrays[k] for k in ("count", "back1", "low", "high", "p2", "back2", "last", "p3"))

    def find(self, words: np.ndarray) -> np.ndarray:
        return self.words.search(words)

    def pair(self, rank: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Where level 2 has these successors of the words of these ranks, or -1."""
        value = lambda i: (self.high[i].astype(np.uint64) << np.uint64(32)) | self.low[i]
        return lower_bound(*self.span(self.from1, rank), words >> np.uint64(64 - PAIR_BITS), value)

    def triple(self, pair: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Where level 3 has these successors of the pairs at these places of level 2, or -1."""
        return lower_bound(*self.span(self.from2, pair), words >> np.uint64(64 - TRIPLE_BITS), self.last.__getitem__)

    @staticmethod
    def span(pointers: elias_fano.EliasFano, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return pointers.access(i).astype(np.int64), pointers.access(i + 1).astype(np.int64)

    def weights(self, pointers: elias_fano.EliasFano, back: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Back-off weights; 1 for a context that nothing follows."""
        a, b = self.span(pointers, i)
        return np.where(a < b, PROBABILITY[back[i]], 1.0)


class OpenShards(OrderedDict):
    """A worker's open files, those used last; OPENED counts openings."""

    OPENED = 0

    def get_shard(self, path: str) -> Shard:
        if path in self:
            self.move_to_end(path)
            return self[path][0]
        OpenShards.OPENED += 1
        data = open_file(path)
        self[path] = (Shard(data), 0 if isinstance(data, np.memmap) else len(data))
        while len(self) > 1 and (len(self) > OPEN_FILES or sum(n for _, n in self.values()) > OPEN_BYTES):
            self.popitem(last=False)
        return self[path][0]


class Model:
    """The files' place and the corpus totals."""

    def __init__(self, path: str, shards: int, tokens: int, distinct: int):
        self.path, self.shards, self.tokens, self.distinct = path, shards, tokens, distinct

    def score(self, tokens: Tokens) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score and score."""
        g = tokens.distinct()
        count, back1, back2 = np.zeros(len(g.words)), np.ones(len(g.words)), np.ones(len(g.context))
        own2, own3 = np.zeros(len(g.context)), np.zeros(len(g.head))
        rank, place = np.full(len(g.words), -1, np.int64), np.full(len(g.context), -1, np.int64)
        files = held(("shards", self.path), OpenShards)
        for s, w, p, t in g.shards(self.shards) if self.tokens else ():
            opened = files.get_shard(f"{self.path}/shard-{s:06d}")
            found = opened.find(g.words[w])
            w, known = w[found >= 0], found[found >= 0]
            rank[w], count[w], back1[w] = known, opened.count[known], opened.weights(opened.from1, opened.back1, known)
            p = p[rank[g.context[p]] >= 0]
            found = opened.pair(rank[g.context[p]], g.words[g.word[p]])
            p, known = p[found >= 0], found[found >= 0]
            place[p], own2[p], back2[p] = known, PROBABILITY[opened.p2[known]], opened.weights(opened.from2, opened.back2, known)
            t = t[place[g.head[t]] >= 0]
            found = opened.triple(place[g.head[t]], g.words[g.last[t]])
            own3[t[found >= 0]] = PROBABILITY[opened.p3[found[found >= 0]]]
        base = (count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))
        pair = own2 + back1[g.context] * base[g.word]
        triple = np.log10(own3 + back2[g.head] * pair[g.tail])
        logs = np.log10(pair)[g.pair_at]
        logs[g.inner] = triple[g.triple_at]
        ends = np.add.reduceat
        return (np.asarray(tokens.sizes, np.int64), ends((count > 0)[g.at].astype(np.int64), g.starts), ends(np.log10(base)[g.at], g.starts), ends(logs, g.starts))


def fit(training: DataFrame, path: str) -> Model:
    """Counts the texts of training and writes the shards to path."""
    chars = training.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-int(chars) // SHARD_CHARS))

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        arrays = build_shard([unpack(np.frombuffer(b, np.uint8), BLOCK) for b in rows["block"]])
        write_file(f"{path}/shard-{int(key[0]):06d}", pack(arrays, TRIE))
        trim()
        return pd.DataFrame({"shard": [int(key[0])], "tokens": [int(arrays["count"].sum())], "distinct": [int((arrays["count"] > 0).sum())]})

    blocks = training.select("text").mapInArrow(count_batches(shards), "shard long, block binary")
    totals = blocks.repartition(shards, "shard").groupBy("shard").applyInPandas(merge, "shard long, tokens long, distinct long").collect()  # a row for each shard
    return Model(path, shards, sum(r["tokens"] for r in totals), sum(r["distinct"] for r in totals))


def score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids = Tokens(), []

        def flush() -> pa.RecordBatch:
            n, known, base, score = model.score(tokens)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for whole in batches:
            for batch in slices(whole, "text"):
                tokens.add(texts_of(batch, "text"))
                ids += batch.column("doc_id").to_pylist()
                if tokens.total >= FLUSH_TOKENS:
                    yield flush()
                    tokens, ids = Tokens(), []
                    trim()
        if ids:
            yield flush()
        del tokens
        trim()

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores every row of docs (doc_id, text), learning from those not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(doc_mod("doc_id", HELD_OUT_OF) == HELD_OUT, F.lit(False)))
    model = fit(rows.filter(~F.col("held_out")), new_path(docs.sparkSession, "ngrams"))
    scored = rows.select("doc_id", "text").mapInArrow(score_batches(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held_out = F.coalesce(doc_mod("doc_id", HELD_OUT_OF) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
