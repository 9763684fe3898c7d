"""Packing token sequences by best-fit decreasing.

A document of more than `window` tokens is first cut into full windows, each a
sequence of its own; its rest and all shorter documents are packed in
decreasing order into the open sequence with the least room that still takes
them. A segment tree over room 0..window finds that sequence in log2(window)
steps. Packing runs in groups of documents (`GROUP_DOCS` at most on average,
dealt by a hash of the piece and of the input partition that it comes from, so that neither one id nor one repeated row fills a group), so memory
is bounded and the number of groups follows the input; each group leaves few open sequences.

Only lengths and checksums travel: texts are tokenised where they are read, in small batches.

Defined results: a null or empty text is one piece, the end id; repeated rows
are packed as often as they occur; an empty table gives an empty table; other
columns are ignored; a document of any length is cut into as many windows as
it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ENCODER_BYTES, batch_rows, crc, encoder, kept_table, slices, table, texts_of, tokenizer_path, trim

WINDOW, END_ID = 2048, 1
#: Documents that are packed together, on average.
GROUP_DOCS = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class RoomTree:
    """Sequences by their remaining room; the leaves of an implicit segment tree count them."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.by_room: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.by_room[room].append(sequence)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least `need` that an open sequence has."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:  # up to the first right neighbour that holds a sequence
            if not i & 1 and self.count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size

    def take(self, room: int) -> int:
        i = room + self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.by_room[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each length (at most window) its sequence and offset there, and the number of sequences."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = RoomTree(window), 0
    for i in order.tolist():
        need = int(lengths[i])
        room = tree.tightest(need) if need < window else None
        if room is None:
            s, room = n, window
            n += 1
        else:
            s = tree.take(room)
        sequence[i], offset[i] = s, window - room
        if room > need:
            tree.add(room - need, s)
    return sequence, offset, n


def pieces_batches(tokenizer: str, end_id: int, window: int):
    """A mapInArrow function: (doc_id, text) -> pieces of at most window tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for whole in batches:
            for batch in slices(whole, "text", ENCODER_BYTES):
                out: list[list] = [[], [], [], [], []]
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts_of(batch, "text"), end_id), strict=True):
                    n = len(ids) // 4
                    for at in range(0, n, window):
                        piece = ids[4 * at : 4 * (at + window)]
                        for column, value in zip(out, (doc, at, len(piece) // 4, crc(piece), n)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                del out
        trim()

    return run


def pack_group(window: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").drop(columns="pack_group")
        sequence, offset, _ = best_fit_decreasing(pieces["length"].to_numpy(), window)
        return pieces.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Every piece of every document of docs (doc_id, text) with its sequence and offset."""
    groups = max(1, -(-docs.count() // group_docs))
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces_batches(tokenizer, end_id, window), PIECES)
    grouped = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id()), F.lit(groups)).cast("long"))
    with batch_rows(docs.sparkSession):
        grouped = kept_table(grouped, "pieces")
    return grouped.groupBy("pack_group").applyInPandas(pack_group(window), PACKED)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
