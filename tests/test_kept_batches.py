"""Kept tables are made with small Arrow batches, whatever their texts' lengths."""

import pandas as pd
from pyspark.sql import functions as F

from marginalia.sources.shared import BATCH_BYTES, kept


def test_kept_tables_send_small_batches(spark):
    @F.pandas_udf("long")
    def batch_chars(text: pd.Series) -> pd.Series:
        return pd.Series([int(text.str.len().sum())] * len(text))

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    got = kept(texts.select(batch_chars("text").alias("n")), "batches").agg(F.count("*"), F.max("n")).first()
    assert got[0] == 3000 and got[1] < 1.2 * BATCH_BYTES
    assert spark.conf.get(name) == before
