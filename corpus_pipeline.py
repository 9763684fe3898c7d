"""A training corpus from raw documents: language, quality, near duplicates, benchmark leaks, packing.

Every stage but the last returns the columns of documents; rows that a stage rejects are
not in its result.

Defined results: an empty table stays empty through every stage; columns beside doc_id, text, lang, source and n_chars are
carried along, whatever their names. A null or empty text, or one without a letter, is rejected by the language stage, one
that fails the base rules or is depleted by the quality stage. Documents of a null id, lang or source are judged as any
other. Of equal or near-equal texts the row with the least doc_id stays (null ids last), of wholly repeated rows one;
ties are settled by the text's hash. A text of any length passes whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontaminate, language_id, near_dedup, packing, quality_rules
from marginalia.llm.common import kept_table, table, tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language_stage), ("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: Stages whose result is a table that they have written.
WRITTEN = {"language", "decontamination"}

#: No SQL: the classifier, the signatures and the tokenizer can't be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        if name not in WRITTEN:
            docs = kept_table(docs, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
