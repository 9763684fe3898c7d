"""The pipeline's stages send texts to workers in small Arrow batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, language_id, packing
from marginalia.llm.common import BATCH_BYTES, table, tokenizer_path


def test_stages_send_small_batches(spark, sf_dir, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"), F.lit(None).cast("string").alias("lang"))

    def small(row):
        def run(batches):
            for batch in batches:
                assert batch.nbytes < 1.2 * BATCH_BYTES
                yield row(batch)

        return lambda *_: run

    def pieces(batch):
        n = len(batch)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x] * n, pa.int64()) for x in (0, 1, 0, 1))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    monkeypatch.setattr(language_id, "keep_batches", small(lambda x: x))
    monkeypatch.setattr(decontaminate, "clean_batches", small(lambda x: x))
    monkeypatch.setattr(packing, "pieces_batches", small(pieces))
    assert language_id.keep(docs).count() == 3000
    assert decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).count() == 3000
    assert packing.pack(docs, tokenizer_path()).count() == 3000
    assert spark.conf.get(name) == before
