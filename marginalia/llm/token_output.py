"""Token-id output: ORC files of integer ids, one row for each document.

ORC encodes the id lists with its integer run-length encoding (RLEv2). Each
stripe carries row indexes and a Bloom filter on doc_id, so a reader takes
stripes in parallel and skips those whose statistics or filter exclude the
wanted documents. Files hold disjoint ranges of (doc_id, hash of text, input partition) in ascending order; their number
follows the bytes of text, `FILE_BYTES` a file, and the ranges split an id, or a row, that repeats.

Defined results: a null or empty text is the end id alone; rows with equal ids
are all written, ordered by the text's hash; a null id sorts first; an empty
table gives an empty table; further columns of the input are ignored. A text of
any length is one row; of 2^31 tokens or more it would not fit ORC's lists and raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ENCODER_BYTES, crc, encoder, new_path, slices, table, texts_of, tokenizer_path, trim

END_ID = 1
FILE_SCHEMA = "doc_id long, part int, part_end long, ids array<int>"
#: Rows between two entries of ORC's row index, and the stripes' size in bytes.
INDEX_STRIDE, STRIPE_BYTES = 1000, 16 << 20
#: Bytes of text for each file.
FILE_BYTES = 64 << 20


def encode_batches(path: str, end_id: int):
    """A mapInArrow function: sorted (doc_id, text) -> rows of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        encode = encoder(path).encode
        for whole in batches:
            for batch in slices(whole, "text", ENCODER_BYTES):
                ids = encode(texts_of(batch, "text"), end_id)
                sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                ends = np.cumsum(sizes)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)
                ends = start + ends
                start = int(ends[-1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(ends), lists], names=["doc_id", "part", "part_end", "ids"])
                del ids, flat, lists
        trim()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Tokenises docs (doc_id, text) and writes ORC files to path, in ascending doc_id order."""
    n = partitions or max(1, -(-int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("place"))
    ordered = rows.repartitionByRange(n, "doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "place")
    (
        ordered.select("doc_id", "text").mapInArrow(encode_batches(tokenizer, end_id), FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with doc_ids only theirs, by a filter that ORC applies to statistics and Bloom filters."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crcs = np.fromiter((crc(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])), np.int64, len(lists))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("part_end"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs)], names=["doc_id", "part", "part_end", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at path.

    The parts' starts come from one count for each file: as many rows as files
    were written, whatever the number of documents.
    """
    rows = read_token_files(spark, path).mapInArrow(digest_batches, "doc_id long, part int, part_end long, n_tokens long, ids_crc32 long")
    totals = sorted((r["part"], r["n"]) for r in read_token_files(spark, path).groupBy("part").agg(F.max("part_end").alias("n")).collect())
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    parts = spark.createDataFrame(starts, "part int, before long")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("part_end") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_digest(spark, path)
