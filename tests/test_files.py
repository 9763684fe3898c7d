import literal_queries
import pytest
from pyspark.sql import functions as F

from marginalia.sources import files
from marginalia.sources import reports as R


def odd_decoder(content):
    if b"break" in content:
        raise ValueError("broken")
    return [p for p in content.decode().split("|") if p]


FILES = {"a.txt": b"one\ftwo", "b.TXT": "é".encode(), "c.txt": b"", "d.bin": b"x", "e.txt": b"\xff\xfe", "sub/f.txt": b"three", "g.txt": b"y" * 200}


def test_pages_and_quarantine(spark, tmp_path):
    files.register(spark)
    (tmp_path / "sub").mkdir()
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content)
    df = spark.read.format("paged_files").option("path", f"file://{tmp_path}").option("suffix", ".txt").option("max_mb", str(100 / 1024 / 1024)).load()
    assert df.rdd.getNumPartitions() == len(FILES)
    got = sorted(((r["path"].removeprefix(f"{tmp_path}/"), r["page_no"], r["text"], r["error_code"]) for r in df.collect()), key=str)
    want = [("a.txt", 1, "one", None), ("a.txt", 2, "two", None), ("b.TXT", 1, "é", None), ("c.txt", None, None, "no_file"), ("d.bin", None, None, "invalid_type"), ("e.txt", None, None, "corrupt"), ("g.txt", None, None, "too_large"), ("sub/f.txt", 1, "three", None)]
    assert got == want


def test_stream_takes_each_file_once(spark, tmp_path):
    files.register(spark)
    (tmp_path / "in").mkdir()
    found = []
    for part in (("a", b"1|2"), ("b", b"break")), (("c", b"3"), ("d", b"")):
        for name, content in part:
            (tmp_path / "in" / name).write_bytes(content)
        stream = spark.readStream.format("paged_files").option("path", str(tmp_path / "in")).option("decoder", "test_files:odd_decoder").load()
        run = stream.writeStream.foreachBatch(lambda df, _: found.extend((r["text"], r["error_code"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        assert run.awaitTermination(120)
    assert sorted(found, key=str) == sorted([("1", None), ("2", None), (None, "corrupt"), ("3", None), (None, "no_file")], key=str)


def test_reports_become_files_of_their_stems_or_none(spark, tmp_path):
    files.register(spark)
    report = R.rendered(literal_queries._report(spark), "md").select("stem", "body")
    report.unionByName(report).write.format("report_files").option("path", str(tmp_path / "out")).mode("append").save()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a-2.md", "a.md"] and (tmp_path / "out" / "a.md").read_text() == literal_queries.RENDERED
    bad = spark.range(6).repartition(3).select(F.col("id").cast("string").alias("stem"), F.when(F.col("id") == 5, F.raise_error(F.lit("no"))).otherwise(F.lit("body")).cast("string").alias("body"))
    with pytest.raises(Exception):
        bad.write.format("report_files").option("path", str(tmp_path / "none")).mode("append").save()
    assert not (tmp_path / "none").exists() or list((tmp_path / "none").iterdir()) == []
