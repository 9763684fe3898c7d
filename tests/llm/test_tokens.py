"""Token files and packing against the plain tokenizer."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marginalia.llm import packing, token_output
from marginalia.llm.common import encoder, new_path, tokenizer_path

DOCS = [(3, "Hello  world\nthe cat's <|endoftext|> Ünïcode"), (1, None), (2, ""), (2, "tie"), (None, "no id"), (9, "word " * 5000), (4, "a b  c"), (3, "Hello  world\nthe cat's <|endoftext|> Ünïcode")]


PLAIN = Tokenizer.from_file(tokenizer_path())


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "7 as ids", "8 as part", "9 as start", "'x' as lang")


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aZtrevld.,'s!&*7_ \n\u2605<|\u0301\u00a0\u00df\u00c9\u00e9\u00d7\u00aa\u0130\u03a3", max_size=40)))
def test_chunks_encode_as_whole_text(text):
    got = encoder(tokenizer_path()).encode([text.encode("utf-8", "replace")], 1)[0]
    assert np.frombuffer(got, "<u4").tolist() == plain_ids(text.encode("utf-8", "replace").decode())


def test_token_files_round_trip(spark):
    path = new_path(spark, "test")
    token_output.write_token_files(frame(spark, DOCS), path, tokenizer_path(), partitions=3)
    got = sorted(map(tuple, token_output.token_digest(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 2, 3, 3, 4, 9]
    at = 0
    for _, start, n, _ in got:  # gapless, in order of id
        assert start == at
        at += n
    key = lambda r: (r[0] or 0, r[1], r[2])
    assert sorted(((d, n, c) for d, _, n, c in got), key=key) == sorted(((d, len(plain_ids(t)), crc(plain_ids(t))) for d, t in DOCS), key=key)
    some = token_output.read_token_files(spark, path, [9]).collect()
    assert [r["ids"] for r in some] == [plain_ids("word " * 5000)]


def test_files_follow_bytes_and_split_one_id(spark, monkeypatch):
    monkeypatch.setattr(token_output, "FILE_BYTES", 2000)
    rows = [(7, f"text {i} of one id") for i in range(600)] + [(8, "one repeated row")] * 600
    path = new_path(spark, "test")
    token_output.write_token_files(frame(spark, rows).repartition(6), path, tokenizer_path())
    files = token_output.read_token_files(spark, path).groupBy("part").count().collect()
    assert len(files) > 5 and max(r["count"] for r in files) < 600
    assert token_output.token_digest(spark, path).agg({"n_tokens": "sum"}).first()[0] == sum(len(plain_ids(t)) for _, t in rows)


def test_stripes_carry_indexes_that_skip_rows(spark):
    """The files' footers name a row index and a Bloom filter stream for doc_id, and a reader by id takes in few rows."""
    rows = [(2 * i, "some words " * 20) for i in range(30_000)]
    path = new_path(spark, "test")
    token_output.write_token_files(frame(spark, rows), path, tokenizer_path(), partitions=2)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    parts = [f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().startswith("part-")]
    assert len(parts) == 2
    reader = jvm.org.apache.orc.OrcFile.createReader(parts[0], jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == token_output.INDEX_STRIDE and reader.getCompressionKind().toString() == "ZSTD"
    kinds = set()
    rows_of = reader.rows()
    footer = rows_of.readStripeFooter(reader.getStripes().get(0))
    for i in range(footer.getStreamsCount()):
        if footer.getStreams(i).getColumn() == 1:  # doc_id
            kinds.add(footer.getStreams(i).getKind().toString())
    rows_of.close()
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    # an id between two others: statistics can't exclude it, the Bloom filter can
    for wanted, most in (([31], 0), ([4000], 2 * token_output.INDEX_STRIDE)):
        took = token_output.read_token_files(spark, path, wanted)
        assert took.count() == (0 if most == 0 else 1)
        plan = took._jdf.queryExecution().executedPlan()
        assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in took._jdf.queryExecution().toString() or "In(doc_id" in took._jdf.queryExecution().toString(), plan


def test_empty_tables(spark):
    empty = frame(spark, [])
    path = new_path(spark, "test")
    token_output.write_token_files(empty, path, tokenizer_path())
    assert token_output.token_digest(spark, path).count() == 0
    assert packing.pack(empty, tokenizer_path()).count() == 0


def check_packed(rows, docs, window):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    total = sum(len(plain_ids(t)) for _, t in docs)
    assert sum(r["length"] for r in rows) == total
    for r in rows:
        texts = [plain_ids(t) for d, t in docs if d == r["doc_id"]]
        assert any(len(ids) == r["doc_tokens"] and crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for ids in texts)
    return len(sequences) * window - total


@pytest.mark.parametrize("window", [8, 64, 2048])
def test_pack_keeps_every_token(spark, window):
    rows = packing.pack(frame(spark, DOCS), tokenizer_path(), window=window).collect()
    check_packed(rows, DOCS, window)


def test_one_repeated_row_is_dealt_out(spark):
    rows = [(None, "the same row again and again")] * 400
    packed = packing.pack(frame(spark, rows).repartition(16), tokenizer_path(), window=64, group_docs=50).collect()
    check_packed(packed, rows, 64)
    assert len({r["sequence_id"] >> 32 for r in packed}) >= 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_matches_brute_force(lengths):
    got = packing.best_fit_decreasing(np.asarray(lengths, np.int64), 32)[2]
    rooms = []
    for need in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= need]
        if fit:
            best = min(fit)
            rooms.remove(best)
            rooms.append(best - need)
        else:
            rooms.append(32 - need)
    assert got == len(rooms)


def test_little_padding(spark, sf_dir):
    rows = packing.op8_packing(spark, sf_dir).collect()
    used = sum(r["length"] for r in rows)
    assert used / (2048 * len({r["sequence_id"] for r in rows})) > 0.97
