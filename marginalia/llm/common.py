"""Helpers that the operators of this folder share.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return (`bytes.split()` splits UTF-8 at exactly these).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where shared files go if the session names no folder (tests on one machine).
DEFAULT_SHARED = "/tmp/checkpoints"
#: Entries that a worker's word cache holds before it starts afresh.
CACHE_ENTRIES = 300_000
ENCODER_ENTRIES, ENCODER_BYTES = 600_000, 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, with its scheme. A default is set only where it names none and one machine does all the work."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(DEFAULT_SHARED)
        path = DEFAULT_SHARED
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/marginalia-{kind}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, kind: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, and lost executors lose nothing."""
    return Scratch(df.sparkSession, kind).keep(df, "table")


class Scratch:
    """Tables in a folder of their own below the shared folder."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.path, self.n = spark, new_path(spark, kind), 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read again."""
        self.n += 1
        path = f"{self.path}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes the tables; nothing may read them any more."""
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of an Arrow batch that goes to a worker (a longer row is a batch of its own), and its rows unless a caller names fewer.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000


@contextlib.contextmanager
def batch_rows(spark: SparkSession, n: int = BATCH_ROWS):
    """Tables kept inside are made with about BATCH_BYTES and at most n rows in an Arrow batch, so that batches of long texts stay small.

    A whole batch stands in the executor's memory outside the heap and in the worker, and what large ones leave behind there isn't given back.
    """
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(n), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_mod(column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


_HELD: dict = {}


def trim() -> None:
    """Gives freed memory back; else it stays with the worker. Every function of batches ends with it, so that a worker starts the next task small.

    What a worker has imported stays: after the first time it isn't searched again, which would take longer than a small task.
    """
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def held(owner, make):
    """What owner keeps between a worker's tasks. A worker holds one owner's things; another's are dropped first."""
    if owner not in _HELD:
        _HELD.clear()
        trim()
        _HELD[owner] = make()
    return _HELD[owner]


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each window of k words; a shorter text is one shingle, no words are none."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n] + np.uint64(j + 1))
    return h


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """UTF-8 of a string column, without decoding."""
    return batch.column(column).cast(pa.large_binary()).to_pylist()


#: Rows of a part that slices() gives.
SLICE_ROWS = 8192


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4_000_000):
    """Parts of a batch with about so many bytes of text and SLICE_ROWS rows at most, a single row at least."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, total, start = [], 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most_bytes or i - start >= SLICE_ROWS:
            ends.append((start, i))
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        ends.append((start, len(lengths)))
    for a, b in ends:
        yield batch.slice(a, b - a)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(dict):
    """A piece's or chunk's bytes -> its ids as little-endian 32-bit integers.

    The tokenizer's rules never join characters across white space. A plain text (printable ASCII and Latin-1 letters,
    no special token) is cut by PIECES as the tokenizer's own pattern cuts it; NFC changes nothing there and
    lower case is plain, so new pieces are encoded with normalisation and splitting left out, many
    at a time, and cut behind the word-end ids. In other texts each white-space chunk
    that isn't plain is encoded under the full rules.
    """

    PLAIN = bytes([*b"\t\n\v\f\r", *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3])
    PIECES = re.compile(rb"[a-z\x80-\xbf\xc3]+|[0-9]|'(?:[stmd]|re|ve|ll)|[!-/:-@\[-`{-~]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.pieces = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.pieces.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def plain(self, text: bytes) -> bool:
        return not text.translate(None, self.PLAIN) and b"<|" not in text and b"\xc3\x97" not in text and b"\xc3\xb7" not in text

    def cut(self, text: bytes) -> list[bytes] | None:
        """The pieces of a plain text; None for others."""
        if not self.plain(text):
            return None
        try:
            return self.PIECES.findall(text.lower() if text.isascii() else text.decode().lower().encode())
        except UnicodeDecodeError:  # bytes that are no UTF-8
            return None

    def units(self, text: bytes, whole: set[bytes]) -> list[bytes]:
        """Pieces, and chunks that only the full rules can encode; the latter are added to `whole`."""
        pieces = self.cut(text)
        if pieces is not None:
            return pieces
        out: list[bytes] = []
        for chunk in text.split():
            pieces = self.cut(chunk)
            if pieces is None:
                whole.add(chunk)
                out.append(chunk)
            else:
                out += pieces
        return out

    def learn(self, units: set[bytes], whole: set[bytes]) -> None:
        """Adds what is new: `whole` under the full rules, the other units as pieces that the tokenizer neither changes nor splits."""
        if len(self) + len(units) > ENCODER_ENTRIES:
            self.clear()
        pieces = list(units.difference(self, whole))
        parts = [pieces[at : at + 500] for at in range(0, len(pieces), 500)]
        for part, e in zip(parts, self.pieces.encode_batch_fast([b" ".join(x).decode() for x in parts], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            cuts, data = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
            self.update(zip(part, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
        rest = list(whole.difference(self))
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False), strict=True):
                self[c] = np.asarray(e.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes | None], end_id: int) -> list[bytes]:
        """For each text its ids and the end id."""
        whole: set[bytes] = set()
        split = [self.units(t or b"", whole) for t in texts]
        self.learn(set().union(*split), whole)
        end, get = np.asarray([end_id], "<u4").tobytes(), self.__getitem__
        return [b"".join(map(get, units)) + end for units in split]


def encoder(path: str) -> WordEncoder:
    return held(("encoder", path), lambda: WordEncoder(path))
