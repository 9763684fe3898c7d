"""Every stage against the operator's own verdicts, and the stages in turn."""

import corpus_pipeline as P
from marginalia.llm import decontaminate, language_id, near_dedup, packing, quality_rules
from marginalia.llm.common import kept_table, table


def test_stages_keep_what_operators_keep(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    columns = docs.columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    def step(at):
        nonlocal docs
        docs = kept_table(P.STAGES[at][1](spark, docs, sf_dir), "test")
        assert docs.columns == columns
        return ids(docs)

    labels = language_id.label_documents(docs)
    assert step(0) == ids(labels.filter(f"lang_pred != 'und' and score >= {language_id.LEAST_SCORE}"))
    verdicts = quality_rules.judge(docs)
    assert step(1) == ids(verdicts.filter("kept"))
    classes = near_dedup.near_duplicates(docs)
    assert step(2) == ids(classes.filter("representative"))
    leaks = set(ids(decontaminate.find_leaks(docs, bench)))
    assert step(3) == sorted(set(ids(docs)) - leaks)
    packed = P.STAGES[4][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(ids(docs))
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in P.run(spark, sf_dir).collect()} == {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packed}


def test_stages_take_odd_rows(spark, sf_dir):
    text = "the cat and the dog went to see one more house by sea and land, then slept well"
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, "123 !!", "en", "a", 6), (4, text, "en", None, 9), (4, text, "en", None, 9), (None, text, "en", "b", 9), (None, text + " again", None, "b", 9), (5, text.upper() * 3000, "en", "b", 9)]
    frame = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema).selectExpr("*", "1 as node", "2 as score", "'h' as host")
    for _, stage in P.STAGES:
        assert stage(spark, frame, sf_dir).count() <= 8 or stage is P.STAGES[4][1]
        assert stage(spark, frame.limit(0), sf_dir).count() == 0
    kept = [tuple(r)[:2] for r in P.near_dedup_stage(spark, frame, sf_dir).collect()]
    assert sorted(kept, key=str).count((4, text)) == 1
    assert (None, text) not in kept
