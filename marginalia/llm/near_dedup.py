"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A text's set is its windows of five words (a shorter text is one window),
weighted 1 + ln(count). ProbMinHash lets every element arrive as a Poisson
process with its weight as rate; each arrival falls on one of `COMPONENTS`
components, which keeps the element that arrived first. An element stops as
soon as its next arrival is later than every component's first. Two texts agree
in a component with the probability Jaccard similarity J_P of their weighted sets.

Identical texts are one node, named by its least row (null id last, doc_id, text hash), so the least
node of a class names the class. A node's components form `BANDS` bands of `ROWS`;
nodes that share a band meet in a bucket (a pair with similarity 0.8 meets with
probability 0.9998, in 7.5 buckets on average). Pairs are proposed in rounds, each linear in the
members of buckets:

1. every member with its bucket's hub, the member that meets most others in all its buckets, as an original meets its copies;
2. then, in buckets whose members are still in different classes, every member with the hub of the largest
   class beside the first hub's, and with its `NEIGHBOURS` neighbours of other classes in the order of their signatures,
   each time from another component on; up to `ROUNDS` times, and only as long as a round finds links (with `exact=True`, a share of `WORTH`).

Proposed pairs whose signatures agree in less than `ESTIMATE` (four standard deviations under the threshold) are
dropped; all others are verified on whole texts by exact J_P >= `SIMILARITY`. Classes are the connected components of
verified links, by rounds on tables (one aggregation each). No bucket, class or row is capped. After the rounds alone a link can stay
unfound where its two texts meet in large buckets only and neither is near a hub. With `exact=True`, as the query and the pipeline have it, all pairs of
different classes that share a bucket are then compared in blocks, so no likely pair is left out: texts go only where a member has a likely link, and a task holds two blocks.
That is quadratic in the members that stay in different classes of one bucket (the tests compare both with brute force).

Defined results: one row for each input row: doc_id, class_id (the least doc_id
of its class), n_links (links of its text to other texts that were verified to
join classes), representative (the row with that id, and
of rows with that id the least text hash's; of wholly repeated rows all). A text that is null or has no word is a class of its own; repeated
rows and equal texts share a class; a null id never represents a class that has another; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Scratch, batch_rows, kept_table, mix, shingle_hashes, slices, table, texts_of, trim, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 36, 7
COMPONENTS = BANDS * ROWS
#: Pairs below this estimate aren't verified; its standard deviation is 0.025 at 0.8.
ESTIMATE = 0.7
#: Members that each member is compared with in the order of signatures, and the rounds of it.
NEIGHBOURS, ROUNDS = 3, 2
#: With exact: the share of a round's pairs that must be links for another round before the blocks; fewer hardly spare them work.
WORTH = 0.01
#: With exact: members of a bucket that are compared with each other, or with as many others, in one task.
BLOCK = 1024
#: Bytes of their texts.
BLOCK_BYTES = 16 << 20
#: What names one block or two.
GROUP = ["bucket", "i", "j"]
#: Keys of nodes (KEY bytes) that are broadcast, or fewer rows that are wider; more are joined by a shuffle.
BROADCAST_NODES, KEY = 500_000, 25
#: Rows of an Arrow batch; one of pairs holds two texts a row.
BATCH_ROWS = 1000
#: Bytes of text that are signed together, and arrivals that are drawn at a time: what a processor's own memory holds.
SIGN_BYTES, ARRIVALS = 256 << 10, 1 << 14


def weighted(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    elements, counts = np.unique(windows, return_counts=True)
    return elements, 1 + np.log(counts)


def weighted_set(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    return weighted(shingle_hashes(word_hashes(text or b""), SHINGLE))


def weighted_sets(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """weighted_set of each text; windows are hashed over all texts at once, and those across two texts left out."""
    words = [word_hashes(t or b"") for t in texts]
    windows, ends = shingle_hashes(np.concatenate(words), SHINGLE), np.cumsum([len(w) for w in words])
    return [weighted(windows[end - len(w) : end - SHINGLE + 1] if len(w) >= SHINGLE else shingle_hashes(w, SHINGLE)) for w, end in zip(words, ends.tolist())]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = COMPONENTS) -> np.ndarray:
    """len(sets) x m: for each component the element that arrives first. Sets must not be empty.

    Elements draw several arrivals at a time once many are past, so that a text of few elements takes few turns;
    those drawn beyond the last component's first win nothing.
    """
    sizes = [len(e) for e, _ in sets]
    element, weight = np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    first, winner = np.full(len(sets) * m, np.inf), np.zeros(len(sets) * m, np.uint64)
    time, arrival, latest = np.zeros(len(element)), 0, np.empty(len(sets))
    while len(element):
        n = max(1, min(arrival // 4, ARRIVALS // len(element)))
        turns = np.arange(arrival + 1, arrival + n + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        arrival += n
        h = mix(element + turns)
        gaps = np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        times = np.subtract.accumulate(np.concatenate([time[None], gaps]))[1:]
        component = mix(h ^ np.uint64(0xD6E8FEB86659FD93))
        component -= component // np.uint64(m) * np.uint64(m)
        cell = row * m + component.astype(np.int64)
        early = times < first[cell]
        at, t, e = cell[early], times[early], np.broadcast_to(element, cell.shape)[early]
        np.minimum.at(first, at, t)
        won = first[at] == t
        winner[at[won]] = e[won]
        time, live = times[-1], row[np.flatnonzero(np.diff(row, prepend=-1))]
        latest[live] = first.reshape(-1, m)[live].max(1)
        active = time < latest[row]
        if not active.all():
            element, weight, row, time = element[active], weight[active], row[active], time[active]
    return winner.reshape(-1, m)


def bucket_keys(signature: np.ndarray) -> np.ndarray:
    """rows x BANDS 64-bit keys."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key + parts[:, :, j])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard similarity of two weighted sets."""
    keys, where = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[where[: len(a[0])]], y[where[len(a[0]) :]] = a[1], b[1]
    ratio = np.divide(x, y, out=np.full(len(keys), np.inf), where=y > 0)
    order = np.argsort(-ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    xs, ys = np.cumsum(x), y.sum() - np.cumsum(y)
    last = np.searchsorted(-ratio, -ratio, side="right") - 1  # of those with the same ratio
    both = (x > 0) & (y > 0)
    return float((1 / (xs[last[both]] / x[both] + ys[last[both]] / y[both])).sum())


SIGNED = "doc_id long, own binary, bytes long, bands array<long>, signature binary"
#: Bytes of a node's key: whether the id is null, the id in an order of bytes, the text's hash.
HASH = 16
_SIGN = -(1 << 63)


def own_key() -> Column:
    """A row's key by (null id last, doc_id, hash of text): 25 bytes."""
    number = F.lpad(F.hex(F.coalesce("doc_id", F.lit(0).cast("long")).bitwiseXOR(F.lit(_SIGN))), 16, "0")
    return F.unhex(F.concat(F.when(F.col("doc_id").isNull(), F.lit("01")).otherwise(F.lit("00")), number, F.md5(F.coalesce("text", F.lit("")))))


def doc_of(key: Column) -> Column:
    """The doc_id in a key."""
    number = F.conv(F.hex(F.substring(key, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))
    return F.when(F.hex(F.substring(key, 1, 1)) == "00", number)


def text_of(key: Column) -> Column:
    return F.substring(key, 10, HASH)


def sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the text, bands and low bytes of the signature; the last two null for a text without words."""
    for whole in batches:
        bands, low = [], []
        for batch in slices(whole, "text", SIGN_BYTES):
            sets = weighted_sets(texts_of(batch, "text"))
            full = [len(bands) + i for i, s in enumerate(sets) if len(s[0])]
            bands += [None] * len(sets)
            low += [None] * len(sets)
            if full:
                signed = signatures([s for s in sets if len(s[0])])
                for i, keys, data in zip(full, bucket_keys(signed), (signed & np.uint64(255)).astype(np.uint8)):
                    bands[i], low[i] = keys, data.tobytes()
            del sets
        columns = {"doc_id": whole.column("doc_id"), "own": whole.column("own"), "bytes": pc.binary_length(whole.column("text")).cast(pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64())), "signature": pa.array(low, pa.binary())}
        yield pa.RecordBatch.from_pydict(columns)
        del bands, low
    trim()


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures' low bytes; fewer than 256 components, so that a byte counts them."""
    return ((a == b).view(np.uint8).sum(-1, dtype=np.uint8) / COMPONENTS - 1 / 256) / (1 - 1 / 256)


def likely_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        su, sv = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, COMPONENTS) for c in ("su", "sv"))
        yield pdf.loc[agreement(su, sv) >= ESTIMATE, ["u", "v"]]
    trim()


def verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text_u"):
            sets: dict[bytes, tuple] = {}
            v, texts_u, texts_v = batch.column("v").to_pylist(), texts_of(batch, "text_u"), texts_of(batch, "text_v")
            keep = []
            for key, tu, tv in zip(v, texts_u, texts_v):
                if key not in sets:
                    sets[key] = weighted_set(tv)
                keep.append(similarity(weighted_set(tu), sets[key]) >= SIMILARITY)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
            del sets, texts_u, texts_v
        del whole
    trim()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: for every node of edges (u, v) that isn't the least of its component the least one.

    Edges point from the greater node to the lesser, and u's least v is its parent. In each round an edge to the parent moves on to the parent's parent,
    and any other edge becomes one from v to that. So each edge stays one edge, components stay as they are, and paths to the roots shorten by half.
    Only parents are aggregated; the joins by u are of two tables, of which one is broadcast or else shuffled, which Spark can split.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    while True:
        parents = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("last")), "parents")
        small = parents.count() <= BROADCAST_NODES * KEY // (3 * KEY)
        near = F.broadcast if small else lambda df: df
        up = parents.join(near(parents.select(F.col("u").alias("m"), F.col("m").alias("up"))), "m", "left")
        if not up.filter("m != last or up is not null").limit(1).count():
            return parents.select(F.col("u").alias("node"), F.col("m").alias("root"))
        up = up.select("u", "m", F.coalesce("up", "m").alias("up"))
        edges = scratch.keep(edges.join(near(up), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("up").alias("v")), "edges")


def neighbour_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of (bucket, place): likely pairs of each row and the NEIGHBOURS rows before it in its bucket that are in other classes."""
    rest = None
    for pdf in batches:
        old = 0 if rest is None else len(rest)
        rows = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        low = np.frombuffer(b"".join(rows["signature"]), np.uint8).reshape(-1, COMPONENTS)
        bucket, root, node = rows["bucket"].to_numpy(), pd.factorize(rows["root"])[0], rows["node"]
        out = []
        for back in range(1, NEIGHBOURS + 1):
            i = np.arange(max(old, back), len(rows))
            i = i[(bucket[i] == bucket[i - back]) & (root[i] != root[i - back])]
            i = i[agreement(low[i], low[i - back]) >= ESTIMATE]
            out += [(max(a, b), min(a, b)) for a, b in zip(node.iloc[i], node.iloc[i - back])]
        yield pd.DataFrame(out, columns=["u", "v"])
        rest = rows.iloc[-NEIGHBOURS:].reset_index(drop=True)
    trim()


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of (bucket, i, j), as many whole groups at a time as end in a batch."""
    rest, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in GROUP])
        cuts = np.flatnonzero((key != np.column_stack([key[:, 0] if last is None else last, key[:, :-1]])).any(0))
        last = key[:, -1]
        if len(cuts):
            cut = int(cuts[-1])
            if rest or cut:
                yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest, batch = [], batch.slice(cut)
        rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


class Blocks:
    """Members of whole groups, each group one block or two of a bucket, in their order."""

    def __init__(self, members: pa.Table):
        column = {c: members.column(c).combine_chunks() for c in (*GROUP, "block", "root", "bands", "signature")}
        self.key = np.stack([column[c].to_numpy() for c in GROUP])
        self.ends = [*(np.flatnonzero((self.key[:, 1:] != self.key[:, :-1]).any(0)) + 1).tolist(), members.num_rows]
        self.block, self.root = column["block"].to_numpy(), column["root"].dictionary_encode().indices.to_numpy()
        self.bands = column["bands"].flatten().to_numpy().reshape(-1, BANDS)
        self.low = np.frombuffer(b"".join(column["signature"].to_pylist()), np.uint8).reshape(-1, COMPONENTS)

    def groups(self) -> Iterator[tuple[int, int]]:
        return zip([0, *self.ends], self.ends)

    def likely_pairs(self, start: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with the members of its group that are likely links to other classes, likeliest first. A pair comes in the bucket of the first band that it shares alone."""
        (bucket, i, j), block = self.key[:, start], self.block[start:end]
        band = int(np.flatnonzero(self.bands[start] == bucket)[0])
        first, second = start + np.flatnonzero(block == i), start + np.flatnonzero(block == j)
        for at, u in enumerate(first.tolist()):
            rest = second[at + 1 :] if i == j else second
            rest = rest[self.root[rest] != self.root[u]]
            if not len(rest):
                continue
            close = agreement(self.low[rest], self.low[u])
            rest = rest[np.argsort(-close, kind="stable")][: int((close >= ESTIMATE).sum())]
            rest = rest[(self.bands[rest] == self.bands[u]).argmax(1) == band]
            if len(rest):
                yield u, rest


def block_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of blocks that have a likely link to another class."""
    for members in whole_groups(batches):
        blocks, named = Blocks(members), np.zeros(members.num_rows, bool)
        for group in blocks.groups():
            for u, rest in blocks.likely_pairs(*group):
                named[u] = True
                named[rest] = True
        yield from members.select([*GROUP, "block", "node", "root"]).filter(pa.array(named)).to_batches()
        del members, blocks
    trim()


def class_of(joined: dict[int, int], root: int) -> int:
    """The class that a root's class has been joined to."""
    while root in joined:
        up = joined[root]
        joined[root] = joined.get(up, up)
        root = up
    return root


def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links that join the classes of blocks: every likely pair is compared by its whole texts, unless links found before join its classes.

    Memory is given back once a task and after large groups, since that takes longer than comparing a small one.
    """
    for members in whole_groups(batches):
        blocks, node, size = Blocks(members), members.column("node").to_pylist(), members.nbytes
        found: list[tuple[bytes, bytes]] = []
        for start, end in blocks.groups():
            sets = [weighted_set(t) for t in members.column("text").slice(start, end - start).cast(pa.large_binary()).to_pylist()]
            joined: dict[int, int] = {}
            for u, rest in blocks.likely_pairs(start, end):
                for v in rest.tolist():
                    a, b = class_of(joined, int(blocks.root[u])), class_of(joined, int(blocks.root[v]))
                    if a != b and similarity(sets[u - start], sets[v - start]) >= SIMILARITY:
                        joined[a] = b
                        found.append((max(node[u], node[v]), min(node[u], node[v])))
            del sets
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["u", "v"])
        del members, blocks, node
        if size > 2 * BATCH_BYTES:
            trim()
    trim()


def sized(df: DataFrame, width: int = KEY) -> DataFrame:
    """df, to be broadcast if its rows of so many bytes take no more than BROADCAST_NODES keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_NODES * KEY // width else df


class Links:
    """Buckets, texts and verified links of a table's nodes."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, scratch: Scratch):
        self.scratch = scratch
        members = nodes.select("node", "bytes", F.explode("bands").alias("bucket"))
        sizes = scratch.keep(members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        shared = members.join(sized(sizes), "bucket")
        met = scratch.keep(shared.groupBy("node").agg(F.sum("n").alias("met")), "met")
        self.met, wanted = scratch.keep(shared.drop("n").join(sized(met, KEY + 8), "node"), "buckets"), sized(met.select("node"))
        self.nodes = scratch.keep(nodes.join(wanted, "node", "left_semi"), "members")
        self.low = sized(self.nodes.select("node", "signature"), KEY + COMPONENTS)
        # a text's own row is the least one that has it, so copies are left behind before anything is shuffled
        picked = docs.withColumn("node", own_key()).join(wanted, "node", "left_semi")
        self.texts = scratch.keep(picked.groupBy("node").agg(F.first("text").alias("text")), "texts")
        self.links = self.roots = self.open = None

    def likely(self, pairs: DataFrame) -> DataFrame:
        with_low = pairs
        for node, low in (("u", "su"), ("v", "sv")):
            with_low = with_low.join(self.low.select(F.col("node").alias(node), F.col("signature").alias(low)), node)
        return with_low.mapInPandas(likely_batches, "u binary, v binary")

    def verify(self, pairs: DataFrame) -> int:
        """Adds the pairs (u, v) with exact similarity of SIMILARITY or more, and joins classes by them; the number of them."""
        pairs = self.scratch.keep(pairs, "pairs")
        self.compared = n = pairs.count()
        if not n:
            return self.add(pairs)
        text_u, text_v = (self.texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in ("u", "v"))
        if n <= BROADCAST_NODES // 2:  # then texts of other nodes stay where they are
            pairs = F.broadcast(pairs)
            text_v = text_v.join(pairs.select("v"), "v", "left_semi")
        joined = text_u.join(pairs, "u").join(text_v, "v")
        return self.add(joined.select("u", "v", "text_u", "text_v").mapInArrow(verify_batches, "u binary, v binary"))

    def add(self, links: DataFrame) -> int:
        """Joins classes by verified links (u, v); the number of them."""
        found = self.scratch.keep(links, "links")
        if not (n := found.count()) and self.links is not None:
            return 0
        self.links = found if self.links is None else self.links.union(found)
        known = found if self.roots is None else found.union(self.roots)
        self.roots, self.open = self.scratch.keep(components(known, self.scratch), "roots"), None
        return n

    def to_hubs(self) -> None:
        hubs = self.scratch.keep(self.met.groupBy("bucket").agg(F.max(F.struct("met", "node"))["node"].alias("hub")), "hubs")
        stars = self.met.join(sized(hubs, KEY + 8), "bucket").filter("node != hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
        self.verify(self.likely(stars))

    def unsettled(self) -> DataFrame:
        """bucket, node, met, root, main, blocks: members of buckets that hold more than one class, made once for the same classes.

        main is the class of the bucket's hub, blocks the number of blocks that hold its members.
        """
        if self.open is not None:
            return self.open
        placed = self.met.join(sized(self.roots, 2 * KEY), "node", "left").withColumn("root", F.coalesce("root", "node"))
        blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
        buckets = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max(F.struct("met", "node", "root"))["root"].alias("main"), blocks)
        still = self.scratch.keep(buckets.filter("a != b").drop("a", "b"), "open")
        self.open = self.scratch.keep(placed.drop("bytes").join(sized(still, KEY + 12), "bucket"), "unsettled")
        return self.open

    def to_neighbours(self, turn: int) -> int:
        members, keep = self.unsettled(), self.scratch.keep
        classes = members.filter("root != main").groupBy("bucket", "root").agg(F.count("*").alias("n"), F.max(F.struct("met", "node")).alias("hub"))
        second = keep(classes.groupBy("bucket").agg(F.max(F.struct("n", "hub", "root")).alias("x")).select("bucket", F.col("x.hub.node").alias("hub"), F.col("x.root").alias("hub_root")), "second")
        stars = members.join(sized(second, 2 * KEY + 8), "bucket").filter("root != hub_root").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v"))
        start = turn * COMPONENTS // ROUNDS
        ordered = members.select("bucket", "node", "root").join(self.low, "node")
        ordered = ordered.withColumn("place", F.concat(F.substring("signature", start + 1, COMPONENTS - start), F.substring("signature", 1, start))).repartitionByRange("bucket", "place", "node").sortWithinPartitions("bucket", "place", "node")
        near = ordered.select("bucket", "node", "root", "signature").mapInPandas(neighbour_batches, "u binary, v binary")
        return self.verify(self.likely(stars.union(near).distinct()))

    def to_all(self) -> None:
        """Every pair of different classes that shares a bucket, block by block; texts go only to blocks in which they may have links."""
        dealt = self.unsettled().withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        dealt = dealt.select("bucket", "node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root")
        signed = sized(self.nodes.select("node", "bands", "signature"), KEY + 8 * BANDS + COMPONENTS)
        grouped = lambda df: df.repartition(*GROUP).sortWithinPartitions(*GROUP, "node")
        columns = [*dealt.columns, "bands", "signature"]
        likely = self.scratch.keep(grouped(dealt.join(signed, "node")).select(columns).mapInArrow(block_members, dealt.schema), "likely")
        if likely.count():
            texts = self.texts.join(sized(likely, 3 * KEY), "node").join(signed, "node")
            self.add(grouped(texts).select(*columns, "text").mapInArrow(block_links, "u binary, v binary"))


def classified(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, own, root, n_links for every row of docs (doc_id, text); root is the own key of the row that represents the class."""
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        return _classified(docs, exact)


def _classified(docs: DataFrame, exact: bool) -> DataFrame:
    scratch, result = Scratch(docs.sparkSession, "near"), Scratch(docs.sparkSession, "near-classes")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    signed = scratch.keep(docs.select("doc_id", own_key().alias("own"), "text").mapInArrow(sign_batches, SIGNED), "signed")
    by_text = signed.filter("bands is not null").groupBy(text_of(F.col("own")).alias("text_hash"))
    nodes = scratch.keep(by_text.agg(F.min("own").alias("node"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"), F.first("signature").alias("signature")).drop("text_hash"), "nodes")
    found = Links(docs, nodes, scratch)
    found.to_hubs()
    for turn in range(ROUNDS):
        n = found.to_neighbours(turn)
        if not n or exact and n < WORTH * found.compared:  # the blocks compare all that is left
            break
    if exact:
        found.to_all()
    # a pair becomes a link once: only members of different classes are paired, and a link makes them one
    degree = found.links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    degree = sized(scratch.keep(degree, "degree"), KEY + 8)
    placed = scratch.keep(nodes.select("node").join(sized(found.roots, 2 * KEY), "node", "left").join(degree, "node", "left").select(text_of(F.col("node")).alias("text_hash"), F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "placed")
    # a text without words is no node: it keeps its row as a class
    rows = signed.select("doc_id", "own", text_of(F.col("own")).alias("text_hash")).join(placed, "text_hash", "left")
    out = result.keep(rows.select("doc_id", "own", F.coalesce("root", "own").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "rows")
    scratch.drop()
    return out


def near_duplicates(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, class_id, n_links, representative for every row of docs (doc_id, text)."""
    return classified(docs, exact).select("doc_id", doc_of(F.col("root")).alias("class_id"), "n_links", (F.col("own") == F.col("root")).alias("representative"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns of docs."""
    rows = classified(docs, exact=True)
    gone = kept_table(rows.filter("own != root").select("own").distinct(), "gone")
    repeated = kept_table(rows.filter("own = root").groupBy("own").agg(F.count("*").alias("n")).filter("n > 1").select("own"), "repeated")
    own = docs.select(F.col("doc_id").cast("long"), "text", F.struct(*docs.columns).alias("row")).select(own_key().alias("own"), "row")
    left = own.join(sized(gone), "own", "left_anti")
    once = left.join(sized(repeated), "own", "left_anti")
    twice = left.join(sized(repeated), "own", "left_semi").dropDuplicates(["own"])
    return once.unionByName(twice).select("row.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), exact=True)
