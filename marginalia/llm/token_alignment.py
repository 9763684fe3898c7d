"""Alignment of two tokenizers' tokens over the same bytes, with DuckDB inside each block of rows.

Both tokenizers treat what stands between two cuts alone: a cut is before a single space whose neighbours are neither white space nor
U+2581. A block (BLOCK_BYTES of text) is cut into such units, and each different unit is encoded and aligned once, over one
axis of bytes on which the units lie side by side:

* each tokenizer's tokens are a table of intervals (unit, id, lo, hi) that cover the axis;
* an ASOF join finds the B token in which an A token begins, a range join the B tokens that begin inside it: all overlaps, each once;
* a window sum over the ends that both have numbers the groups.

Documents are their units' rows, counted. What a block links is counted by pair of ids there, and Spark adds the blocks' counts; the
sums come back to each block for its own pairs alone, so no table of all pairs is broadcast, collected or held in one task.

Defined results: a null or empty text, and one whose bytes the tokens don't give back (B takes U+2581 for a space), has no tokens:
zeros and an empty groups_sha256, and links nothing; repeated rows count as often as they occur; a null doc_id stays; an empty table gives an empty
table; other columns are ignored. A text is a row of one block, so a very long one takes memory as its length does.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch_rows, held, slices, table, tokenizer_path, trim

BLOCK_BYTES, ARROW_ROWS = 4 << 20, 1000
#: Units that are encoded as one text, and texts at once.
JOINED_UNITS, ENCODED = 500, 1000
DUCKDB_MEMORY = "400MB"
CUT = re.compile(r" (?<=[^\s▁] )(?=[^\s▁])")
#: What splitting at each space makes of a text that CUT would not cut so.
ODD = r"^$|^[\s\x1c-\x1f\x{85}\pZ]|[\s\x1c-\x1f\x{85}\pZ]$|▁"
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ALIGNED = f"block long, {DOCUMENT}, pairs array<int>, times array<int>, pair_a array<int>, pair_b array<int>, pair_docs array<int>"
JOINED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """A, a byte-level vocabulary, and B, pieces with U+2581 for spaces and <0xHH> for bytes; the bytes of every id."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        alphabet, file = byte_alphabet(), Tokenizer.from_file(a)
        entries, special = file.get_vocab(with_added_tokens=False), file.get_added_tokens_decoder()
        self.a_bytes = [b""] * (max([*entries.values(), *special]) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry)
        # The file's merges are its entries in order of id, and this library takes a fifth of the time for them.
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.a_bytes) if i not in special}, special_tokens={})
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]

        self.said = [f"{mark}{i}" for mark, n in ((";", len(self.a_bytes)), (",", len(self.a_bytes)), ("|", len(self.b_bytes)), (",", len(self.b_bytes))) for i in range(n)]
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        #: Where in `said` an id of A (first in its group or not) and one of B start.
        self.at = {"a_first": 0, "a_next": n_a, "b_first": 2 * n_a, "b_next": 2 * n_a + n_b}
        self.sizes = [np.fromiter(map(len, x), np.int32) for x in (self.a_bytes, self.b_bytes)]

    def ids(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of a space and each text, by A and by B, which adds the space itself."""
        for at in range(0, len(texts), ENCODED):
            part = texts[at : at + ENCODED]
            yield from zip([self.a.encode_ordinary(" " + u) for u in part], self.b.encode(part, num_threads=1), strict=True)

    def encode(self, units: list[str], plain: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which units, each behind a space, both give back byte for byte, in some order, and these units' ids by A and by B in that order.

        Plain units are encoded many at a time, since they would be cut apart again.
        """
        parts = [plain[at : at + JOINED_UNITS].tolist() for at in range(0, len(plain), JOINED_UNITS)] + [[i] for i in single.tolist()]
        order, out = array("i"), (array("i"), array("i"))
        texts = [" ".join([units[i] for i in part]) for part in parts]
        for part, text, (a, b) in zip(parts, texts, self.ids(texts), strict=True):
            if b"".join(map(self.a_bytes.__getitem__, a)) == (" " + text).encode() == b"".join(map(self.b_bytes.__getitem__, b)):
                order.extend(part)
                out[0].extend(a)
                out[1].extend(b)
        return tuple(np.frombuffer(x, np.int32) if len(x) else np.empty(0, np.int32) for x in (order, *out))


def cut_texts(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Different units, places of those that are plain and of those to be encoded alone, and each text's units.

    Most texts have single spaces only: these are cut and numbered by Arrow. Texts with a word at whose ends something other than one space stands are cut by CUT.
    """
    words = pc.split_pattern(texts.fill_null(""), " ")
    coded = words.flatten().dictionary_encode()
    odd = pc.match_substring_regex(coded.dictionary, ODD).to_numpy(zero_copy_only=False)
    flat, edges = coded.indices.to_numpy(), words.offsets.to_numpy()
    found, units = [flat[a:b] for a, b in zip(edges, edges[1:])], coded.dictionary.to_pylist()
    n, slow = len(units), np.flatnonzero(np.logical_or.reduceat(odd[flat], edges[:-1])) if len(found) else []
    more = Index()
    for i in slow:
        text = texts[int(i)].as_py()
        found[i] = np.fromiter((n + more[u] for u in CUT.split(text)), np.int32) if text else np.empty(0, np.int32)
    return units + list(more), np.flatnonzero(~odd), n + np.arange(len(more)), found


class Index(dict):
    """Numbers what is looked up, from 0."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def intervals(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray, ends: np.ndarray) -> pa.Table:
    """unit, place, id, lo, hi of the tokens of units side by side, in that order with these ends."""
    own = sizes[ids]
    hi = np.cumsum(own, dtype=np.int32)
    lo = hi - own
    return pa.table({"unit": order[np.searchsorted(ends, lo, side="right")], "place": np.arange(len(ids), dtype=np.int32), "id": ids, "lo": lo, "hi": hi})


# Statements over tables a and b of intervals, and occurrences (doc, unit). The axis' places rise with its bytes, so an order by place is one by lo and hi.
LINKS = """CREATE TABLE links AS SELECT unit, a, b, count(*)::INT AS n FROM (
 SELECT a.unit, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.lo >= b.lo
 UNION ALL SELECT a.unit, a.id, inner_b.id FROM a JOIN (SELECT * FROM b WHERE lo NOT IN (SELECT lo FROM a)) inner_b ON inner_b.lo > a.lo AND inner_b.lo < a.hi) GROUP BY ALL"""
GROUPED = """CREATE TABLE grouped_{side} AS SELECT unit, place, id, coalesce(sum(met) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS grp, met
 FROM (SELECT *, (hi IN (SELECT hi FROM {other}))::INT AS met FROM {side})"""
UNITS = """CREATE TABLE units AS SELECT * FROM (SELECT unit, count(*) AS n_a, sum(met)::BIGINT AS n_groups FROM grouped_a GROUP BY unit)
 JOIN (SELECT unit, count(*) AS n_b FROM grouped_b GROUP BY unit) USING (unit) JOIN (SELECT unit, sum(n)::BIGINT AS n_links FROM links GROUP BY unit) USING (unit)"""
#: Each token as its place in `said`, groups in order and A before B.
SAID = """SELECT unit, said FROM (SELECT unit, grp, 0 AS side, place, id + CASE WHEN lag(met, 1, 1) OVER (ORDER BY place) = 1 THEN {a_first} ELSE {a_next} END AS said FROM grouped_a
 UNION ALL SELECT unit, grp, 1, place, id + CASE WHEN lag(met, 1, 1) OVER (ORDER BY place) = 1 THEN {b_first} ELSE {b_next} END FROM grouped_b) ORDER BY grp, side, place"""
OCCURRENCES = "CREATE TABLE seen AS SELECT doc, unit, count(*) AS n FROM occurrences GROUP BY ALL"
SUMS = "SELECT doc, sum(seen.n * n_a)::BIGINT AS n_a, sum(seen.n * n_b)::BIGINT AS n_b, sum(seen.n * n_groups)::BIGINT AS n_groups, sum(seen.n * n_links)::BIGINT AS n_links FROM seen JOIN units USING (unit) GROUP BY doc"
HELD = "CREATE TABLE pairs_held AS SELECT doc, a, b, sum(seen.n * links.n)::INT AS n FROM seen JOIN links USING (unit) GROUP BY ALL"
PAIRS = "CREATE TABLE pairs AS SELECT a, b, docs, (row_number() OVER (ORDER BY docs DESC, a, b) - 1)::INT AS pair FROM (SELECT a, b, count(*)::INT AS docs FROM pairs_held GROUP BY ALL)"
LISTS = "SELECT doc, pair, n FROM pairs_held JOIN pairs USING (a, b) ORDER BY doc, pair"


def align_block(tools: Tokenizers, doc_ids: pa.Array, texts: pa.Array, block: int) -> pa.Table:
    """ALIGNED rows of a block's documents, and one more with its pairs."""
    units, plain, single, found = cut_texts(texts)
    order, ids_a, ids_b = tools.encode(units, plain, single)
    ends = np.cumsum(1 + pc.binary_length(pa.array(units, pa.string())).to_numpy(zero_copy_only=False)[order], dtype=np.int32)
    good = np.zeros(len(units), bool)
    good[order] = True
    del units
    told = [x if good[x].all() else x[:0] for x in found]
    a, b = (intervals(ids, sizes, order, ends) for ids, sizes in zip((ids_a, ids_b), tools.sizes))
    occurrences = pa.table({"doc": np.repeat(np.arange(len(told), dtype=np.int32), [len(x) for x in told]), "unit": np.concatenate([*told, np.empty(0, np.int32)])})
    del ids_a, ids_b
    with duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY}) as db:
        for name, rows in (("a", a), ("b", b), ("occurrences", occurrences)):
            db.register(name, rows)
        del a, b
        for statement in (LINKS, GROUPED.format(side="a", other="b"), GROUPED.format(side="b", other="a"), UNITS, OCCURRENCES, HELD, PAIRS):
            db.execute(statement)
        said = db.execute(SAID.format(**tools.at)).fetchnumpy()
        sums = db.execute(SUMS).fetchnumpy()
        lists = db.execute(LISTS).fetchnumpy()
        pairs = db.execute("SELECT a, b, docs FROM pairs ORDER BY pair").fetchnumpy()
    words = list(map(tools.said.__getitem__, said["said"].tolist()))
    starts = np.flatnonzero(np.diff(said["unit"], prepend=-1))
    of_unit = [""] * len(good)
    for unit, x, y in zip(said["unit"][starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(words)]):
        of_unit[unit] = "".join(words[x:y])
    digests = [hashlib.sha256("".join(map(of_unit.__getitem__, x.tolist()))[1:].encode()).hexdigest() if len(x) else "" for x in told]
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    columns = [pa.array(np.full(len(told), block)), doc_ids]
    for name in names[2:6]:
        count = np.zeros(len(told), np.int64)
        count[sums["doc"]] = sums[name]
        columns.append(pa.array(count))
    edges = pa.array(np.searchsorted(lists["doc"], np.arange(len(told) + 1)).astype(np.int32))
    columns += [pa.array(digests, pa.string()), *(pa.ListArray.from_arrays(edges, pa.array(lists[name].astype(np.int32))) for name in ("pair", "n"))]
    none = pa.nulls(len(told), pa.list_(pa.int32()))
    rows = pa.table([*columns, none, none, none], names=names)
    own = [pa.array([pairs[c].astype(np.int32)], pa.list_(pa.int32())) for c in ("a", "b", "docs")]
    last = pa.table([pa.array([block]), *(pa.nulls(1, rows.schema.field(n).type) for n in names[1:9]), *own], names=names)
    return pa.concat_tables([rows, last]) if len(pairs["a"]) else rows


def align_batches(path_a: str, path_b: str):
    """A mapInArrow function: (doc_id, text) -> ALIGNED, in blocks of about BLOCK_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = held(("tokenizers", path_a, path_b), lambda: Tokenizers(path_a, path_b))
        block, parts, total = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, parts, total
            rows = pa.Table.from_batches(parts)
            yield from align_block(tools, *(rows[c].combine_chunks() for c in ("doc_id", "text")), block).to_batches()
            block, parts, total = block + 1, [], 0
            trim()

        for whole in batches:
            for part in slices(whole, "text", BLOCK_BYTES // 8):
                parts.append(part)
                total += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if total >= BLOCK_BYTES:
                    yield from flush()
        if parts:
            yield from flush()

    return run


def join_counts(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """A cogrouped applyInArrow function: a block's documents and its pairs' corpus-wide counts -> JOINED."""
    if not documents.num_rows:
        return pa.table([pa.array([], pa.string() if x.endswith("string") else pa.int64()) for x in JOINED.split(", ")], names=[x.split()[0] for x in JOINED.split(", ")])
    pair = counts["pair"].to_numpy()
    count, best = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
    count[pair], best[pair] = counts["count"].to_numpy(), counts["best"].to_numpy()
    lists, times = (documents[name].combine_chunks() for name in ("pairs", "times"))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    own, n = lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    summed = lambda values: (x := np.concatenate([[0], np.cumsum(values[own] * n)]))[ends] - x[ends - sizes]
    out = {name: documents[name] for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(out | {"n_best": summed(best), "count_sum": summed(count), "groups_sha256": documents["groups_sha256"]})


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A table of ALIGNED rows of docs (doc_id, text)."""
    with batch_rows(docs.sparkSession, ARROW_ROWS):
        return Scratch(docs.sparkSession, "alignment").keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align_batches(path_a, path_b), ALIGNED), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count, best: in how many documents each pair of ids is linked, and whether no pair of its A id is in more."""
    totals = block_pairs(aligned).groupBy("a", "b").agg(F.sum("docs").alias("count"))
    highest = totals.groupBy("a").agg(F.max("count").alias("highest"))
    return totals.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))


def block_pairs(aligned: DataFrame) -> DataFrame:
    """block, pair (its number there), a, b, docs."""
    return aligned.filter("pair_a is not null").select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_docs")).alias("pair", "x")).select("block", "pair", F.col("x.pair_a").alias("a"), F.col("x.pair_b").alias("b"), F.col("x.pair_docs").alias("docs"))


def with_counts(aligned: DataFrame) -> DataFrame:
    """JOINED: every document with the corpus-wide counts of its links."""
    counts = block_pairs(aligned).join(pair_counts(aligned), ["a", "b"]).select(F.col("block").alias("of_block"), "pair", "count", "best")
    documents = aligned.filter("pair_a is null").drop("pair_a", "pair_b", "pair_docs")
    return documents.groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(join_counts, JOINED)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_counts(align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")))
