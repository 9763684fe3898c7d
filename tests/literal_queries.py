"""Tests as queries on small literal rows, for what the tables never hold, with the rows that must come out.

What must come out was worked out by hand from the rules; its SQL is a VALUES list.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marginalia.functions import text as T
from marginalia.operators import extraction as E
from marginalia.operators import grounding as G
from marginalia.operators import notes as N
from marginalia.operators import pages as P
from marginalia.operators import providers as L
from marginalia.operators import validation as V
from marginalia.plans.catalogue import NORM_SQL
from marginalia.sources import reports as R
from marginalia.sources import settings as S
from marginalia.sources import tables
from marginalia.sources.tables import read_reports
from marginalia.streaming import jobs as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def cell(value) -> str:
    if value is None:
        return "NULL"
    return str(value).upper() if isinstance(value, bool) else repr(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def must_be(schema: str, rows: list[tuple]) -> str:
    """SQL that gives rows of a schema."""
    names = [part.split() for part in schema.split(",")]
    shown = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {TYPES[kind]}) AS {n}' for n, kind in names)} FROM (VALUES {shown}) t({', '.join(n for n, _ in names)})"


def query(schema: str, rows: list[tuple]):
    """Registers a function of a session under its name, with the rows that it must give."""

    def add(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(spark)
        ORACLE[function.__name__] = must_be(schema, rows)
        return function

    return add


def joined(column: str, by: str = ",") -> F.Column:
    return F.array_join(column, by).alias(column)


# ------------------------------------------------------------------ text
@query("id int, tidied string, compared string", [(1, "information and more\n\nfin", "informa tion and more fin"), (2, "STRASSE Straße", "strasse strasse"), (3, "Département \"x\" - y", "département x y"), (4, "plain text", "plain text"), (5, "1⁄2 cup costs 3.50 $", "1 2 cup costs 3.50 $"), (6, None, None), (7, "", "")])
def exact_text(spark):
    rows = [(1, "informa-\ntion  and\t more \n\n\n\nﬁn­"), (2, "STRASSE Straße"), (3, "D ́epartement “x” – y"), (4, " plain  text "), (5, "½ cup costs 3.50 $"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    return df.select("id", T.tidy_column(F.col("text")).alias("tidied"), T.match_form(F.col("text")).alias("compared"))


@query("id int, title string, heading string, size string, marker string, label string, stem string", [
    (1, "Paper", "Key Findings", "2 KB", "[[Page 1]]", "page 1", "Paper"), (2, "a b.PDFx", "Other", "1.2 MB", "[[Page 12]]", "pages 12-14", "a_b.PDFx"), (3, "", "Limitations Inferred", "0 KB", "[[Page 3]]", "pages 3-5", "document"), (4, "Über_x-1.2", "A", "1024 KB", "[[Page 4]]", "page 4", "Über_x-1.2"),
])
def text_helpers(spark):
    rows = [(1, "Paper.pdf", "key_findings", 2560, [1]), (2, "a b.PDFx", "other", 1310720, [12, 14]), (3, ".pdf", "limitations_inferred", 10, [3, 4, 5]), (4, "Über_x-1.2.PDF", "a", 1048575, [4])]
    df = spark.createDataFrame(rows, "id int, name string, key string, n long, pages array<int>")
    return df.select("id", T.title_from_filename(F.col("name")).alias("title"), T.heading_from_key(F.col("key")).alias("heading"), T.human_size(F.col("n")).alias("size"), T.page_marker(F.element_at("pages", 1)).alias("marker"), T.chunk_label(F.col("pages")).alias("label"), T.export_stem(F.col("name")).alias("stem"))


ANSWERS = [(1, '{"a": 1}'), (2, '```json\n{"a": 2}\n```'), (3, '<think>{"a": 9}</think> Here you are: {"a": 3} Hope it helps.'), (4, "[1, 2]"), (5, "no object"), (6, '<THINK>x\ny</THINK>\n``` {"a": {"b": 6}} ```'), (7, None), (8, '{"a": 8')]


@query("id int, a string", [(1, "1"), (2, "2"), (3, "3"), (4, None), (5, None), (6, '{"b":6}'), (7, None), (8, None)])
def json_answers(spark):
    df = spark.createDataFrame(ANSWERS, "id int, answer string")
    return df.select("id", F.try_variant_get(T.json_object(F.col("answer")), "$.a", "string").alias("a"))


@query("id int, body string, removed int", [(1, "See page 2 and [unverified page reference removed], (p. 1).", 1), (2, "Pages 1–3 and p. 3 hold.", 0), (3, "[unverified page reference removed] and [unverified page reference removed]", 2), (4, "", 0), (5, "grouppage 9 stays", 0)])
def inline_pages_clean(spark):
    rows = [(1, "See page 2 and pp. 3-9, [[Page 1]]."), (2, "Pages 1–3 and p. 3 hold."), (3, "page 3-2 and PAGE 77"), (4, None), (5, "grouppage 9 stays")]
    df = spark.createDataFrame(rows, "id int, body string").withColumn("x", T.clean_inline_pages("body", F.array(*map(F.lit, (1, 2, 3)))))
    return df.select("id", "x.body", "x.removed")


@query("id int, content string", [(1, "a\nb"), (2, ""), (3, ""), (4, "x")])
def tag_contents(spark):
    rows = [(1, "<notes part=1>\na\nb\n</notes> tail"), (2, "no tag"), (3, "<notes></notes>"), (4, "<notes>x</notes><notes>y</notes>")]
    return spark.createDataFrame(rows, "id int, text string").select("id", T.tag_content(F.col("text"), "notes").alias("content"))


MARKDOWN = [(1, "One *two* **three**.\n\n- a <b>\n- `c*d*`"), (2, "[ok](https://x.org) [no](javascript:alert(1)) ![i](http://x/y.png)"), (3, "# Head\n\n| a | b |\n|---|---|\n| 1 | 2 |"), (4, "```py\nx < 1\n```\n\n1. one\n2. two"), (5, None), (6, "> said\n> twice")]


@query("id int, html string", [
    (1, "<p>One <em>two</em> <strong>three</strong>.</p>\n<ul>\n<li>a &lt;b&gt;</li>\n<li><code>c*d*</code></li>\n</ul>"),
    (2, '<p><a href="https://x.org" rel="noopener noreferrer nofollow" target="_blank">ok</a> <a href="#">no</a>) </p>'),
    (3, "<h1>Head</h1>\n<table>\n<thead>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td>2</td>\n</tr>\n</tbody>\n</table>"),
    (4, "<pre><code>x &lt; 1\n</code></pre>\n<ol>\n<li>one</li>\n<li>two</li>\n</ol>"), (5, ""), (6, "<blockquote>\n<p>said\ntwice</p>\n</blockquote>"),
])
def safe_markdown(spark):
    return spark.createDataFrame(MARKDOWN, "id int, text string").select("id", R.safe_html("text").alias("html"))


# ------------------------------------------------------------------ sources
FILES = [(1, "a.pdf", b"%PDF-1.7 x", 10, True, False, 3), (2, "b.txt", b"%PDF-1.7", 8, True, False, 3), (3, "c.PDF", b"MZ", 2, True, False, 3), (4, "d.pdf", b"", 0, True, False, 0), (5, "e.pdf", b"%PDF-", 26 * 1024 * 1024 + 1, True, False, 1), (6, "f.pdf", b" " * 2000 + b"%PDF-1", 2006, False, False, 0), (7, "g.pdf", b"x\n%PDF-1", 8, True, True, 2), (8, "h.pdf", b"%PDF-1", 6, True, False, 0), (9, "i.pdf", b"%PDF-1", 6, True, False, 301), (10, "j.pdf", b"%PDF-1", 6, True, False, 300)]


@query("id int, error_code string, upload int", [(1, None, 202), (2, "invalid_type", 400), (3, "invalid_type", 400), (4, "no_file", 400), (5, "too_large", 413), (6, "corrupt", 202), (7, "encrypted", 202), (8, "empty", 202), (9, "too_many_pages", 202), (10, None, 202)])
def file_quarantine(spark):
    df = spark.createDataFrame(FILES, "id int, path string, content binary, size long, readable boolean, needs_password boolean, page_count int")
    return E.structural_error(df.withColumn("error_code", tables.file_error(F.col("content"), F.col("path"), F.col("size")))).select("id", "error_code", tables.upload_status(F.col("error_code")).alias("upload"))


@query("doc string, headings string, metadata string", [("a", "1 Intro 1|2 Deep 4", "author=Ann|title=T")])
def outline_and_metadata(spark):
    entries = spark.createDataFrame([("a", 1, 1, " Intro ", 1), ("a", 2, 1, "  ", 2), ("a", 3, 2, "Deep", 4), ("a", 4, 1, "Gone", 5), ("a", 5, 1, "Zero", 0)], "doc string, pos int, level int, title string, page int")
    docs = spark.createDataFrame([("a", 4, {"title": " T ", "author": "Ann", "subject": "  ", "creator": None})], "doc string, page_count int, metadata map<string,string>")
    rows = E.outline(entries, docs).join(docs, "doc").withColumn("m", F.sort_array(F.map_entries(E.told_metadata(F.col("metadata")))))
    return rows.select("doc", F.array_join(F.transform("headings", lambda h: F.concat_ws(" ", h["level"].cast("string"), h["title"], h["page"].cast("string"))), "|").alias("headings"), F.array_join(F.transform("m", lambda x: F.concat_ws("=", x["key"], x["value"])), "|").alias("metadata"))


@query("key string, value string", [("A", "1"), ("B", "two words"), ("C", "x=y"), ("D", "")])
def settings_file(spark):
    lines = ["﻿A=1", "# no", "", "B = \"two words\" ", "C='x=y'", "D=", "=none", "just text", "A=2"]
    return S.settings_of(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string"))


BODY = '{"overview":{"title":"%s","title_source":"document","authors":["A"],"date":"","document_type":"P","page_count":2,"filename":"f.pdf","size_bytes":1},"sections":[%s],"metrics":[{"label":"l","value":"v"}],"meta":{"model":"m","chunks":2,"list":[1],"long":"%s"}}'
SECTION_BODY = '{"key":"other","heading":"H","basis":"odd","body_markdown":"b"}'
BODIES = [("a", BODY % ("t" * 600, ",".join([SECTION_BODY] * 45), "x" * 600)), ("b", BODY.replace('"%s"', "7", 1) % ("", "")), ("c", "not JSON"), ("d", '{"overview":{"title":"t","filename":"f"}}'), ("e", BODY % ("t", SECTION_BODY, "s"))]


@query("doc string, title_chars int, n_sections int, basis string, supported boolean, verified boolean, date string, meta string", [("a", 500, 40, "mixed", True, False, None, "chunks=2|model=m"), ("b", None, None, None, None, None, None, None), ("c", None, None, None, None, None, None, None), ("d", None, None, None, None, None, None, None), ("e", 1, 1, "mixed", True, False, None, "chunks=2|long=s|model=m")])
def report_limits(spark):
    r = tables.read_reports(spark.createDataFrame(BODIES, "doc string, body string"))
    meta = F.array_join(F.transform(F.sort_array(F.map_entries("report.meta")), lambda x: F.concat_ws("=", x["key"], x["value"])), "|")
    first, n = F.col("report.sections")[0], F.when(F.col("report").isNotNull(), F.size("report.sections"))
    return r.select("doc", F.length("report.overview.title").alias("title_chars"), n.alias("n_sections"), first["basis"].alias("basis"), first["supported"].alias("supported"), F.col("report.metrics")[0]["verified"].alias("verified"), F.col("report.overview.date").alias("date"), meta.alias("meta"))


# ------------------------------------------------------------------ pages
GOOD = "The river was measured in eleven places over winter."
SPANS = [("a", 1, 0, 1, 1, True, 1.0, "Two "), ("a", 1, 0, 1, 2, True, 1.0, "spans"), ("a", 1, 0, 2, 1, True, 1.0, "second line"), ("a", 1, 0, 3, 1, True, 0.0, "rotated"), ("a", 1, 0, 4, 1, True, 1.0, "  "), ("a", 1, 1, 1, 1, False, 1.0, "image"), ("a", 1, 2, 1, 1, True, 0.99, "other block")]


@query("doc string, page_no int, stream_pos int, text string", [("a", 1, 0, "Two spans\nsecond line"), ("a", 1, 2, "other block")])
def block_texts(spark):
    return E.block_texts(spark.createDataFrame(SPANS, "doc string, page_no int, stream_pos int, line_no int, span_no int, is_text boolean, dx double, text string"))


#: Page a jumps up its left column once in two pairs; page b is in order; c has one column, out of order.
LAID = [("a", 1, 0, 50.0, 400.0, 290.0, 420.0, "left low"), ("a", 1, 1, 50.0, 100.0, 290.0, 120.0, "left top"), ("a", 1, 2, 310.0, 100.0, 550.0, 120.0, "right top"), ("a", 1, 3, 310.0, 300.0, 550.0, 320.0, "right low"), ("b", 1, 0, 50.0, 100.0, 290.0, 120.0, "left"), ("b", 1, 1, 310.0, 90.0, 550.0, 120.0, "right"), ("b", 1, 2, 310.0, 300.0, 550.0, 320.0, "right end"), ("c", 1, 0, 50.0, 500.0, 200.0, 520.0, "last"), ("c", 1, 1, 50.0, 20.0, 200.0, 40.0, "first"), ("c", 1, 2, 50.0, 260.0, 200.0, 280.0, "middle")]


def _laid(spark):
    return spark.createDataFrame(LAID, "doc string, page_no int, stream_pos int, x0 double, y0 double, x1 double, y1 double, text string").withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})


@query("doc string, page_no int, disorder double", [("a", 1, 0.5), ("b", 1, 0.0), ("c", 1, 0.5)])
def stream_disorder(spark):
    return P.stream_disorder(_laid(spark))


@query("doc string, page_no int, text string", [("a", 1, "left top\n\nleft low\n\nright top\n\nright low"), ("b", 1, "left\n\nright\n\nright end"), ("c", 1, "first\n\nmiddle\n\nlast")])
def page_texts(spark):
    return E.page_texts(_laid(spark))


#: d: page 2 is read by OCR, 3 has none, 4's can't be read; e: nothing can be read; f: garbled throughout; g: fine.
SCANS = [("d", 1, GOOD, None), ("d", 2, "x", GOOD), ("d", 3, "", None), ("d", 4, "", "zz zz 11 22 33 44 55 66 77 88"), ("e", 1, "", None), ("e", 2, " \n", "short"), ("f", 1, "1 2 3 4 5 6 7 8 9 10 11 12 13 14", None), ("g", 1, GOOD, GOOD + " From OCR.")]


def _scans(spark):
    raw = spark.createDataFrame(SCANS, "doc string, page_no int, text string, ocr_text string")
    return raw, E.final_pages(E.with_ocr(raw))


@query("doc string, page_no int, ocr boolean, still_bad boolean, has_text boolean", [("d", 1, False, False, True), ("d", 2, True, False, True), ("d", 3, False, True, False), ("d", 4, False, True, False), ("e", 1, False, True, False), ("e", 2, False, True, False), ("f", 1, False, True, False), ("g", 1, False, False, True)])
def ocr_results(spark):
    return _scans(spark)[1].select("doc", "page_no", "ocr", "still_bad", "has_text")


@query("doc string, n_pages long, n_text long, error string, warnings string", [
    ("d", 4, 2, None, "1 page(s) had no usable text layer and were read with OCR; expect occasional recognition errors on those pages.|2 page(s) had no readable text (blank, image-only or unreadable fonts) and are not covered by the analysis: 3, 4."),
    ("e", 2, 0, E.SCAN + E.OCR_TRIED, ""), ("f", 1, 0, E.GARBLED + E.OCR_TRIED, ""), ("g", 1, 1, None, ""),
])
def document_status(spark):
    return E.document_status(*_scans(spark), True).withColumn("warnings", F.array_join("warnings", "|"))


#: p ends by an appendix line, q by a heading without its number, r runs to the end; s is too short; t names references in its first half alone.
CITED = [
    ("p", 1, "Intro\ntext one"), ("p", 2, "Body text"), ("p", 3, "Close\n7. References\n[1] A. Nobody.\nReferences\n[2] B."), ("p", 4, "[3] C.\nAppendix A\nmore text"), ("p", 5, "References of no account"),
    ("q", 1, "One"), ("q", 2, "Two"), ("q", 3, "Three\nBIBLIOGRAPHY\n[1] x"), ("q", 4, "[2] y\n  Attention\nVisualizations\nshown here"), ("q", 5, "tail"),
    ("r", 1, "One"), ("r", 2, "Two"), ("r", 3, "Literature Cited\n[1] x"), ("r", 4, "[2] y"), ("s", 1, "One"), ("s", 2, "References\n[1]"),
    ("t", 1, "References\nx"), ("t", 2, "Two"), ("t", 3, "Three"), ("t", 4, "Four"), ("t", 5, "Five"), ("t", 6, "Six"),
]


def _cited(spark):
    pages = spark.createDataFrame(CITED, "doc string, page_no int, text string").withColumn("has_text", F.lit(True))
    return pages, spark.createDataFrame([("q", 4, "A Attention Visualizations"), ("q", 3, "Three"), ("q", 4, "tiny"), ("p", 3, "References"), ("r", 1, "Two")], "doc string, page_no int, heading string")


@query("doc string, page_no int, begin int, end_at int", [("p", 3, 35, 52), ("p", 4, 0, 7), ("q", 3, 6, 24), ("q", 4, 0, 6), ("r", 3, 0, 22), ("r", 4, 0, 5)])
def bibliography_spans(spark):
    return E.bibliography_spans(*_cited(spark)).withColumnRenamed("end", "end_at")


@query("doc string, page_no int, analysis_text string", [("p", 3, "Close\n7. References\n[1] A. Nobody."), ("p", 4, "Appendix A\nmore text"), ("q", 3, "Three"), ("q", 4, "Attention\nVisualizations\nshown here"), ("r", 3, ""), ("r", 4, "")])
def without_bibliography(spark):
    return E.without_bibliography(*_cited(spark)).filter(F.col("analysis_text") != F.col("text")).select("doc", "page_no", "analysis_text")


@query("doc string, text string", [("r", "[[Page 1]]\nOne\n\n[[Page 2]]\nTwo"), ("s", "[[Page 1]]\nOne\n\n[[Page 2]]\nReferences\n[1]")])
def full_texts(spark):
    return E.full_texts(E.without_bibliography(*_cited(spark)).filter(F.col("doc").isin("r", "s")))


@query("doc string, description string", [
    ("a", "Filename: a.pdf\nTotal pages: 9 (pages with extractable text: 8)\nEmbedded PDF metadata (may be missing or wrong): title='T', subject='S'\nDetected headings/outline: Intro (p.1); End (p.9)\nThe bibliography (pages 7-8) is omitted from the text below. Pages [2, 3] were read with OCR and may contain recognition errors; do not quote garbled text."),
    ("b", "Filename: b.pdf\nTotal pages: 1 (pages with extractable text: 1)\nEmbedded PDF metadata (may be missing or wrong): none\nDetected headings/outline: none detected"),
])
def document_descriptions(spark):
    rows = [("a", "a.pdf", 9, 8, {"title": "T", "subject": "S", "creator": "x"}, [("Intro", 1, 1), ("End", 1, 9)], [7, 8], [2, 3]), ("b", "b.pdf", 1, 1, {}, [], [], [])]
    return E.described(spark.createDataFrame(rows, "doc string, filename string, page_count int, n_text int, metadata map<string,string>, headings array<struct<title:string,level:int,page:int>>, reference_pages array<int>, ocr_pages array<int>"))


SHORT_PAGES = [("a", 1, "x" * 40), ("a", 2, "y" * 40), ("b", 1, "z" * 60), ("c", 1, "w" * 200), ("c", 2, "v")]


@query("doc string, analysis_chars long, strategy string", [("a", 80, "single-pass"), ("b", 60, "single-pass"), ("c", 201, "map-reduce")])
def strategy_of_one_chunk(spark):
    """A document over the limit that still is one chunk goes in a single pass."""
    return P.strategies(spark.createDataFrame(SHORT_PAGES, "doc string, page_no int, text string"), 50, 130).select("doc", "analysis_chars", "strategy")


@query("doc string, chunk_idx int, label string, n_chars int", [("a", 0, "page 1", 51), ("a", 1, "page 2", 51), ("b", 0, "page 1", 71), ("c", 0, "page 1", 101), ("c", 1, "page 1", 101), ("c", 2, "pages 1-2", 45)])
def chunk_limits(spark):
    """Pages of a chunk's limit of 90 characters; a marker is in its block, and a page without spaces is cut hard."""
    return P.chunks(spark.createDataFrame(SHORT_PAGES, "doc string, page_no int, text string"), 90).select("doc", "chunk_idx", T.chunk_label(F.col("pages")).alias("label"), F.length("text").alias("n_chars"))


# ------------------------------------------------------------------ notes
LONG = "Ice covered the upper station for eighty-seven days in a row"
NOTED = [("a", 1, f"{LONG} this year. Too short. The Quarter flow fell to 41.2% of what it was in Quarter two of the year."), ("a", 2, "The Channel stayed open, as every one of the men at the lower station could see.")]
NOTE_CHUNKS = [("a", 0, [1], f"[[Page 1]]\n{NOTED[0][2]}"), ("a", 1, [2], f"[[Page 2]]\n{NOTED[1][2]}")]


def _noted(spark, annotator=N.extract_notes, repair=None):
    chunks = spark.createDataFrame(NOTE_CHUNKS, "doc string, chunk_idx int, pages array<int>, text string")
    return N.annotate(chunks, G.page_index(spark.createDataFrame(NOTED, "doc string, page_no int, text string")), annotator, repair)


@query("chunk_idx int, points string, concepts string, data string", [
    (0, f"{LONG} this year.@1@{LONG} this year.|The Quarter flow fell to 41.2% of what it was in Quarter two of the year.@1@The Quarter flow fell to 41.2% of what it was in Quarter two of the year.", "Quarter", "The Quarter flow fell=41.2%"),
    (1, "The Channel stayed open, as every one of the men at the lower station could see.@2@The Channel stayed open, as every one of the men at the lower station could see.", "Channel", ""),
])
def extracted_notes(spark):
    schema = "points array<struct<text:string,pages:array<int>,quote:string>>, concepts array<struct<term:string>>, data array<struct<label:string,value:string>>"
    rows = _noted(spark).withColumn("n", F.from_json("note", schema))
    point = lambda p: F.concat_ws("@", p["text"], F.array_join(p["pages"], "+"), p["quote"])
    return rows.select("chunk_idx", F.array_join(F.transform("n.points", point), "|").alias("points"), F.array_join("n.concepts.term", "|").alias("concepts"), F.array_join(F.transform("n.data", lambda d: F.concat_ws("=", d["label"], d["value"])), "|").alias("data"))


def _odd_annotator(text: str):
    """For the first chunk: a quote of another chunk's page, an invented one, pages as text and of other chunks; for the second no JSON."""
    if "[[Page 1]]" not in text:
        return "I can not do that."
    points = [{"text": "kept, quote lost", "pages": ["p. 1"], "quote": "the men at the lower station could see"}, {"text": "found by its quote", "quote": "ICE covered the upper station"}, {"text": "of another chunk", "pages": [2]}, {"text": "no page", "quote": "an invented sentence of some length"}, {"pages": [1]}, "odd"]
    return {"summary": 7, "topics": [" t ", 5, ""], "points": points, "data": [{"label": "l", "value": "v", "pages": "1"}, {"label": "l", "pages": [1]}], "concepts": None}


@query("chunk_idx int, points string, kinds string, data long, topics string, error string", [(0, "kept, quote lost@1@-|found by its quote@1@ICE covered the upper station", "other|other", 1, "t", None), (1, None, None, None, None, "ValueError: no JSON object in the answer")])
def sanitized_notes(spark):
    schema = "topics array<string>, points array<struct<text:string,kind:string,pages:array<int>,quote:string>>, data array<struct<label:string>>"
    rows = _noted(spark, _odd_annotator).withColumn("n", F.from_json("note", schema))
    point = lambda p: F.concat_ws("@", p["text"], F.array_join(p["pages"], "+"), F.coalesce(p["quote"], F.lit("-")))
    some = lambda c: F.when(F.col("n").isNotNull(), c)
    return rows.select("chunk_idx", some(F.array_join(F.transform("n.points", point), "|")).alias("points"), some(F.array_join("n.points.kind", "|")).alias("kinds"), some(F.size("n.data")).cast("long").alias("data"), some(F.array_join("n.topics", "|")).alias("topics"), "error")


@query("chunk_idx int, summary string, error string", [(0, "", None), (1, "mended", None)])
def repaired_notes(spark):
    rows = _noted(spark, _odd_annotator, lambda answer: '```json\n{"summary": "mended"}\n```')
    return rows.select("chunk_idx", F.get_json_object("note", "$.summary").alias("summary"), "error")


@F.pandas_udf(StringType())
def _fitted(note: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(N.fit(json.loads(n), int(m)), ensure_ascii=False) for n, m in zip(note, most)], dtype=object)


#: {"summary": "s", "points": ["aaaa", "bb"], "concepts": ["cc"], "data": [], "limitations_stated": []} is 98 characters long.
FITS = [(1, '{"summary": "s", "points": ["aaaa", "bb"], "concepts": ["cc"], "data": [], "limitations_stated": []}', 200), (2, '{"summary": "s", "points": ["aaaa", "bb"], "concepts": ["cc"], "data": [], "limitations_stated": []}', 95), (3, '{"summary": "s", "points": ["a"], "concepts": ["cc"], "data": [], "limitations_stated": []}', 20), (4, '{"summary": "' + "s" * 900 + '", "points": ["a"]}', 400)]


@query("id int, points string, concepts string, summary_chars int", [(1, '["aaaa","bb"]', '["cc"]', 1), (2, '["aaaa"]', '["cc"]', 1), (3, "[]", "[]", 1), (4, "[]", None, 200)])
def notes_fit(spark):
    rows = spark.createDataFrame(FITS, "id int, note string, most int").withColumn("fitted", _fitted("note", "most"))
    return rows.select("id", F.get_json_object("fitted", "$.points").alias("points"), F.get_json_object("fitted", "$.concepts").alias("concepts"), F.length(F.get_json_object("fitted", "$.summary")).alias("summary_chars"))


def _many_notes(n: int, empty: bool) -> list[tuple]:
    note = lambda i: {"summary": f"s{i}" * (200 if empty else 1), "topics": [], "points": [] if empty else [{"text": f"p{i}-{k}", "kind": "claim", "pages": [i]} for k in range(10)], "concepts": [], "data": [], "limitations_stated": [{"text": f"l{i}", "pages": [i]}], "pages_covered": [i]}
    return [("empty" if empty else "full", i, json.dumps(note(i), ensure_ascii=False)) for i in range(1, n + 1)]


@query("doc string, n_notes int, points string, pages string, error string", [("full", 1, "16", "1+2+3+4+5", None), ("empty", None, None, None, "condensed notes were empty")])
def merged_notes(spark):
    """Five notes of about 650 characters under a budget of 1,200: two and three are merged, with 16 and 24 points, then these two, with eight points of each."""
    notes = spark.createDataFrame(_many_notes(5, False) + _many_notes(5, True), "doc string, chunk_idx int, note string")
    rows = N.reduced(notes, 1200).withColumn("n", F.from_json("notes", "array<struct<points:array<struct<text:string>>,pages_covered:array<int>>>"))
    return rows.select("doc", F.when(F.col("n").isNotNull(), F.size("n")).alias("n_notes"), F.array_join(F.transform("n", lambda x: F.size(x["points"])), "|").alias("points"), F.array_join(F.transform("n", lambda x: F.array_join(x["pages_covered"], "+")), "|").alias("pages"), "error")


@query("title string, keys string, findings string, pages string, metrics string", [(LONG[:3] + " heading", "executive_summary,key_findings,key_concepts,limitations_inferred", "- one (p. 1)\n- two (p. 3)", "1,3", "l=9")])
def drafted_report(spark):
    note = '[{"points":[{"text":"one","pages":[1],"quote":"q"},{"text":"two","pages":[3]}],"concepts":[{"term":"t","explanation":"e","pages":[2]}],"data":[{"label":"l","value":"9","context":"","pages":[1]}]}]'
    notes = spark.createDataFrame([("a", note)], "doc string, notes string")
    raw = N.drafts(notes, spark.createDataFrame([("a", 2, "second"), ("a", 1, "\n  Ice heading \nmore")], "doc string, page_no int, text string"))
    r = F.from_json("raw", "overview struct<title:string>, sections array<struct<key:string,body_markdown:string,pages:array<int>>>, metrics array<struct<label:string,value:string>>")
    return raw.select(r.alias("r")).select("r.overview.title", F.array_join("r.sections.key", ",").alias("keys"), F.col("r.sections")[1]["body_markdown"].alias("findings"), F.array_join(F.col("r.sections")[1]["pages"], ",").alias("pages"), F.array_join(F.transform("r.metrics", lambda m: F.concat_ws("=", m["label"], m["value"])), ",").alias("metrics"))


# ------------------------------------------------------------------ reports
CHECKED_PAGES = [("a", 1, "Slow Rivers\nAnn Lund, 2019"), ("a", 2, "middle"), ("a", 3, "third"), ("a", 4, "A note of 1987 stands here"), ("b", 1, "Nothing of it"), ("c", 1, "text")]
CHECKED_RAW = [
    ("a", '<think>hm</think>```json\n{"overview":{"title":"slow RIVERS","authors":["ann lund","Bo"],"date":"May 1987","document_type":" "},"sections":[{"key":"key_findings","body_markdown":"b","basis":"Interpretation"}],"not_stated":["Dates of visits"]}\n```'),
    ("b", 'Sure! {"overview":{"title":"Invented","date":"2031"},"sections":[{"key":"limitations_stated","heading":"L","body_markdown":"b","basis":"mixed","pages":[1]}]}'),
    ("c", '{"sections":[{"body_markdown":"  "}]}'),
]


def _checked(spark):
    docs = spark.createDataFrame([("a", "a.pdf", 10, 4, {}), ("b", "b.PDF", 10, 1, {"title": "Meta title"}), ("c", "c.pdf", 1, 1, {})], "doc string, filename string, size_bytes long, page_count int, metadata map<string,string>")
    docs = docs.withColumns({"warnings": F.array().cast("array<string>"), "meta": F.lit(None).cast("map<string,string>")})
    return V.validate_reports(G.page_index(spark.createDataFrame(CHECKED_PAGES, "doc string, page_no int, text string")), spark.createDataFrame(CHECKED_RAW, "doc string, raw string"), docs)


@query("doc string, title string, title_source string, authors string, date string, document_type string, not_stated string, basis string, heading string, error string", [
    ("a", "slow RIVERS", "document", "ann lund", "May 1987", "Not determined", "Dates of visits", "interpretation", "Key Findings", None),
    ("b", "Meta title", "pdf_metadata", "", None, "Not determined", "Authors,Date / year", "document", "L", None), ("c", None, None, None, None, None, None, None, None, "no usable sections"),
])
def checked_overviews(spark):
    o, first = "report.overview.", F.col("report.sections")[0]
    return _checked(spark).select("doc", f"{o}title", f"{o}title_source", F.array_join(f"{o}authors", ",").alias("authors"), f"{o}date", f"{o}document_type", F.array_join("report.not_stated", ",").alias("not_stated"), first["basis"].alias("basis"), first["heading"].alias("heading"), "error")


@query("doc string, place int, note string", [("a", 0, "Removed author “Bo”: not found in the PDF's opening pages or metadata."), ("b", 0, "Discarded the generated title because it does not appear in the PDF's opening pages or metadata."), ("b", 1, "Removed date “2031”: not found in the PDF.")])
def overview_notes(spark):
    return _checked(spark).select("doc", F.posexplode("report.validation_notes").alias("place", "note"))


VIEWED = """{"overview":{"title":"T","title_source":"document","authors":[],"date":"2019","document_type":"P","page_count":4,"filename":"a.pdf","size_bytes":2560},"sections":[{"key":"methodology","heading":"M","basis":"mixed","body_markdown":"b","pages":[1,2,4],"evidence":[{"page":2,"quote":"q"}],"supported":true},{"key":"key_findings","heading":"K","basis":"document","body_markdown":"c","pages":[],"evidence":[],"supported":false}],"metrics":[{"label":"l","value":"v","pages":[3],"verified":true}],"references":[{"page":2,"quotes":["q"],"used_in":["M"]}],"not_stated":[],"validation_notes":[],"warnings":["w1","w2"],"meta":{"model":"m"}}"""


def _viewed(spark):
    return tables.read_reports(spark.createDataFrame([("a", VIEWED)], "doc string, body string"))


@query("payload string", [('{"title":"T","title_source":"document","overview":[{"label":"Title","value":"T"},{"label":"Author(s)","value":"Not stated in the document."},{"label":"Date / year","value":"2019"},{"label":"Document type","value":"P"},{"label":"Pages","value":"4"},{"label":"File","value":"a.pdf (2 KB)"}],"sections":[{"key":"methodology","heading":"M","basis":"mixed","basis_label":"Document content with AI interpretation","source":"Pages 1–2, 4","supported":true,"body_markdown":"b","evidence":[{"source":"Page 2","quote":"q"}]},{"key":"key_findings","heading":"K","basis":"document","basis_label":"Document content","source":"","supported":false,"body_markdown":"c","evidence":[]}],"metrics":[{"label":"l","value":"v","source":"Page 3","verified":true}],"references":[{"source":"Page 2","used_in":["M"],"quotes":["q"]}],"not_stated":[],"validation_notes":[],"warnings":["w1","w2"],"meta":{"model":"m"}}',)])
def browser_payload(spark):
    return _viewed(spark).select(F.to_json(R.payload(F.col("report"))).alias("payload"))


@query("job string, step int, opened string, new_warnings string", [("q", 0, "true,true", "w1,w2"), ("r", 1, "true,true", "w2"), ("s", 2, "true,true", "w2"), ("t", 3, "true,true", "w2"), ("u", 4, "true,true", ""), ("v", -1, "true,true", "w2")])
def frontend_view(spark):
    jobs = spark.createDataFrame([("q", "queued", 0.0, []), ("r", "reading", 0.1, ["w1"]), ("s", "analyzing", 0.89, ["w1"]), ("t", "analyzing", 0.9, ["w1"]), ("u", "done", 1.0, ["w1", "w2"]), ("v", "error", 0.5, ["w1"])], "job string, status string, progress double, shown array<string>")
    rows = R.view(jobs.crossJoin(_viewed(spark).select("report")))
    return rows.select("job", "step", F.array_join(F.transform("open_sections", lambda x: x.cast("string")), ",").alias("opened"), F.array_join("new_warnings", ",").alias("new_warnings"))


@query("id int, facts string", [(1, "2 KB · 1 page"), (2, "1.2 MB · 9 pages · text on 7/9 · 2 page(s) via OCR · bibliography skipped")])
def document_facts(spark):
    rows = [(1, (2560, 1, 1, [], [])), (2, (1310720, 9, 7, [2, 3], [9]))]
    return spark.createDataFrame(rows, "id int, d struct<size_bytes:long,pages:int,text_pages:int,ocr_pages:array<int>,reference_pages:array<int>>").select("id", R.facts(F.col("d")).alias("facts"))


@query("id int, error int", [(1, None), (2, 400), (3, 413)])
def export_requests(spark):
    rows = spark.createDataFrame([(1, "md", 10), (2, "docx", 10), (3, "json", (3 << 20) + 1)], "id int, kind string, n int")
    return rows.select("id", R.export_error(F.col("kind"), F.repeat(F.lit("x"), F.col("n"))).alias("error"))


@query("body string", [('{\n  "a": "é",\n  "b": null,\n  "c": [\n    1,\n    2\n  ]\n}',)])
def indented_json(spark):
    rows = spark.createDataFrame([(("é", None, [1, 2]),)], "r struct<a:string,b:string,c:array<int>>")
    return rows.select(R.json_text(F.col("r")).alias("body"))


# ------------------------------------------------------------------ jobs and providers
JOB_EVENTS = [("a", 1, "queued", 0.0), ("a", 2, "reading", 0.1), ("a", 3, "analyzing", 0.6), ("a", 4, "analyzing", 0.4), ("b", 1, "reading", 0.2), ("b", 2, "cancelled", 0.2), ("b", 3, "done", 1.0), ("c", 1, "done", 1.7)]


@query("job_id string, status string, progress double", [("a", "analyzing", 0.6), ("b", "cancelled", 0.2), ("c", "done", 1.0)])
def job_states(spark):
    return J.job_states(spark.createDataFrame(JOB_EVENTS, "job_id string, ts int, status string, progress double"))


@query("job_id string, action string", [("idle", "cancel"), ("read", "purge"), ("unread", "purge")])
def job_expiry(spark):
    rows = [("idle", "reading", 849.0, None, None), ("busy", "analyzing", 850.0, None, None), ("read", "done", 999.0, 960.0, 969.0), ("fresh", "done", 999.0, 960.0, 970.0), ("unread", "error", 999.0, 879.0, None), ("ended", "done", 999.0, 880.0, None)]
    return J.expired(spark.createDataFrame(rows, "job_id string, status string, last_seen double, finished double, delivered double"), 1000.0).select("job_id", "action")


@query("request_id long, reason string", [(1, None), (2, None), (3, "too_many_active"), (4, None), (5, "busy"), (6, None), (7, "rate_limited"), (8, None), (9, None)])
def job_admission(spark):
    """Three an hour and two at once for an address, three at once for the server; what was refused doesn't count, and a run that ends frees its place."""
    rows = [("s", 1, 0.0, "x", 100.0), ("s", 2, 1.0, "x", 50.0), ("s", 3, 2.0, "x", 60.0), ("s", 4, 3.0, "y", 90.0), ("s", 5, 4.0, "z", 9.0), ("s", 6, 60.0, "x", 70.0), ("s", 7, 200.0, "x", 210.0), ("s", 8, 3600.5, "x", 3601.0), ("t", 9, 4.0, "z", 9.0)]
    return J.submissions(spark.createDataFrame(rows, "server string, request_id long, at double, address string, ends double"), 3, 2, 3).select("request_id", "reason")


@query("job_id string, place int, existed boolean, status string", [("a", 1, True, "cancelled"), ("a", 2, False, None), ("b", 1, True, "done"), ("x", 1, False, None)])
def job_cancellation(spark):
    jobs = spark.createDataFrame([("a", "reading"), ("b", "done")], "job_id string, status string")
    return J.cancellations(jobs, spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("x", 1)], "job_id string, place int"))


@query("job_id string, fetched double, found boolean, with_report boolean, delivered double", [("a", 5.0, True, False, None), ("a", 12.0, True, True, 12.0), ("a", 40.0, True, True, 12.0), ("a", 43.0, False, False, None), ("b", 131.0, False, False, None), ("x", 1.0, False, False, None)])
def job_delivery(spark):
    jobs = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "job_id string, done_at double")
    return J.deliveries(spark.createDataFrame([("a", 5.0), ("a", 12.0), ("a", 40.0), ("a", 43.0), ("b", 131.0), ("x", 1.0)], "job_id string, at double"), jobs).withColumnRenamed("at", "fetched")


@query("id int, progress double", [(1, 0.085), (2, 0.235), (3, 0.46875), (4, 1.0), (5, 0.813)])
def job_progress(spark):
    rows = [(1, "reading", 0.5), (2, "notes", 0.0), (3, "notes", 0.5), (4, "done", 1.0), (5, "report", 0.0)]
    return J.overall_progress(spark.createDataFrame(rows, "id int, stage string, fraction double")).select("id", F.round("progress", 9).alias("progress"))


@query("server string, active long, waiting long, busiest_address long", [("s", 3, 1, 2), ("t", 0, 0, 0)])
def job_counters(spark):
    rows = [("s", "queued", "x"), ("s", "reading", "x"), ("s", "analyzing", "y"), ("s", "done", "y"), ("t", "error", "x")]
    return J.counters(spark.createDataFrame(rows, "server string, status string, address string"))


@query("job_id string, status string, progress double, message string, error string", [("a", "queued", 0.0, "Waiting for a free worker", None), ("b", "queued", 0.0, "In queue: 2 document(s) ahead", None), ("c", "analyzing", 0.667, "Writing", None), ("d", "error", 0.5, "Failed", "why")])
def job_payload(spark):
    rows = [("a", "queued", 0.0, "", None, 0), ("b", "queued", 0.0, "", None, 2), ("c", "analyzing", 2 / 3, "Writing", None, None), ("d", "error", 0.5, "Failed", "why", None)]
    return J.public(spark.createDataFrame(rows, "job_id string, status string, progress double, message string, error string, ahead int"))


#: call 1: of two that are ready and fresh the idler one; 2: ties go by place; 3: only one that failed is ready; 4: all cool down; 5: none is usable; 6: longer than the most.
CALLS = [
    (1, "p", 0, False, False, False, 0.0, 2), (1, "q", 1, False, False, False, 0.0, 1), (1, "r", 2, True, False, False, 0.0, 0), (2, "p", 0, False, False, False, 0.0, 1), (2, "q", 1, False, False, False, 0.0, 1),
    (3, "p", 0, False, False, True, 0.0, 0), (3, "q", 1, False, False, False, 12.0, 0), (4, "p", 0, False, False, False, 15.0, 0), (4, "q", 1, False, False, True, 12.5, 3), (5, "p", 0, False, True, False, 0.0, 0), (6, "p", 0, False, False, False, 99.0, 0),
]


@query("call_id int, provider string, wait double", [(1, "q", 0.0), (2, "p", 0.0), (3, "p", 0.0), (4, "q", 2.5), (5, None, None), (6, "p", 65.0)])
def provider_choice(spark):
    rows = spark.createDataFrame(CALLS, "call_id int, provider string, place int, disabled boolean, skipped boolean, failed boolean, cooldown_until double, in_flight int").withColumn("now", F.when(F.col("call_id") == 6, F.lit(0.0)).otherwise(F.lit(10.0)))
    out = L.choose(rows)
    return out.select("call_id", "provider", F.when(F.col("provider").isNotNull(), F.col("wait")).alias("wait"))


ATTEMPTS = [(1, 200, "", None, "x", False, None), (2, 401, "", None, None, False, None), (3, 413, "", None, None, False, None), (4, 400, "Prompt TOO LARGE", None, None, False, None), (5, 400, "bad", None, None, False, None), (6, 429, "", "1", None, False, None), (7, 429, "try again in 7s", None, None, False, None), (8, 503, "", None, None, False, None), (9, 200, "", None, "{", True, None), (10, 200, "", None, " ", False, None), (11, None, None, None, None, False, "timeout"), (12, None, None, None, None, False, "network")]


@query("id int, action string, cooldown double", [(1, "use", 0.0), (2, "disable", 0.0), (3, "skip", 0.0), (4, "skip", 0.0), (5, "fail", 0.0), (6, "retry", 2.0), (7, "retry", 7.5), (8, "retry", 3.0), (9, "double", 0.0), (10, "retry", 1.0), (11, "retry", 5.0), (12, "retry", 2.0)])
def provider_outcomes(spark):
    rows = spark.createDataFrame(ATTEMPTS, "id int, status int, body string, retry_after string, content string, truncated boolean, failure string")
    return L.outcomes(rows).select("id", "action", "cooldown")


@query("job_id string, models_used string, calls long", [("a", "q,p", 3)])
def provider_calls(spark):
    rows = [("a", "p", "use"), ("a", "q", "use"), ("a", "q", "use"), ("a", "r", "retry")]
    return L.used_providers(spark.createDataFrame(rows, "job_id string, provider string, action string")).select("job_id", F.array_join("models_used", ",").alias("models_used"), "calls")


@query("id int, names string, budget int", [(1, "groq,nvidia", 7000), (2, "", 12000), (3, "x", 20000)])
def provider_names(spark):
    rows = [(1, ["nvidia", "groq#2", "groq"], 3500), (2, [], 6001), (3, ["x"], 20000)]
    return spark.createDataFrame(rows, "id int, names array<string>, tokens int").select("id", F.array_join(L.base_names(F.col("names")), ",").alias("names"), L.next_budget(F.col("tokens")).alias("budget"))


@query("id int, hedged boolean, answer string, seconds double", [(1, False, "first", 9.0), (2, True, "second", 32.0), (3, True, "first", 31.0), (4, True, "error", 50.0), (5, False, "error", 5.0), (6, True, "second", 40.0)])
def hedged_calls(spark):
    rows = [(1, 9.0, True, 1.0, True), (2, 60.0, True, 7.0, True), (3, 31.0, True, 7.0, True), (4, 50.0, False, 7.0, False), (5, 5.0, False, 1.0, True), (6, 30.0, False, 15.0, True)]
    return L.hedged(spark.createDataFrame(rows, "id int, first_s double, first_ok boolean, second_s double, second_ok boolean"), 25.0).select("id", "hedged", "answer", "seconds")


@query("request_id long, accepted boolean", [(1, True), (2, True), (3, True), (4, True), (5, False), (6, True), (7, False), (8, True), (9, True)])
def edge_rate_limit(spark):
    """Six a minute and three more at once."""
    rows = [(1, "x", 0.0), (2, "x", 0.0), (3, "x", 0.0), (4, "x", 0.0), (5, "x", 0.0), (6, "x", 10.0), (7, "x", 11.0), (8, "x", 20.0), (9, "y", 0.0)]
    return J.edge_limits(spark.createDataFrame(rows, "request_id long, address string, at double"), 6, 3).select("request_id", "accepted")


# Small literal tables for what the driver's tables never hold.
BLOCKS = [("a", 1, 0, 50.0, 40.0, 550.0, 60.0, "Title across the page"), ("a", 1, 1, 50.0, 300.0, 290.0, 320.0, "left lower"), ("a", 1, 2, 310.0, 100.0, 550.0, 120.0, "right upper"), ("a", 1, 3, 50.0, 100.0, 290.0, 120.0, "left upper"), ("a", 1, 4, 50.0, 400.0, 550.0, 420.0, "middle across"), ("a", 1, 5, 310.0, 500.0, 550.0, 520.0, "right end"), ("a", 1, 6, 50.0, 500.0, 290.0, 520.0, "left end"), ("b", 1, 0, 50.0, 80.2, 550.0, 90.0, "second"), ("b", 1, 1, 50.0, 20.0, 550.0, 30.0, "first")]
LINES = [("a", 1, 1, 18.0, "Main Title Here", False), ("a", 1, 2, 10.0, "Body text that goes on and on.", False), ("a", 1, 3, 12.0, "Methods", False), ("a", 1, 4, 10.0, "Bold lead", True), ("a", 1, 5, 10.0, "Bold sentence.", True), ("a", 2, 1, 10.0, "More body text", False), ("a", 2, 2, 10.0, "Even more body text", False), ("a", 2, 3, 12.0, "123", False), ("a", 2, 4, 10.0, "last body text", False)]
DELAYS = [(1, "7", ""), (2, None, "Rate limit: try again in 1m2.5s please"), (3, None, "try again in 3.2s"), (4, None, "try again in 250ms"), (5, None, "no hint"), (6, "900", "x"), (7, "soon", "Try again in 20s")]
QUOTES = [("a", 1, 1, "the result was 87.5% in all trials"), ("a", 1, 2, "result was 87.5%"), ("a", 1, 3, "The RESULT was 87.5% in all trials."), ("a", 1, 4, "result was 87.5%"), ("a", 2, 1, "result was 87.5%"), ("b", 1, 1, "result was 87.5% in all")]
COERCE = [(1, '[1, 2.0, "p. 3", "2-4", true, 99, null]'), (2, "3"), (3, '"pp 1–2"'), (4, None), (5, '["4-2", "x", 1.5]'), (6, "[]"), (7, "null")]
REPORT = """{"overview":{"title":"A | B","title_source":"filename","authors":["Ann","Bo"],"date":null,"document_type":"Paper","page_count":4,"filename":"a.pdf","size_bytes":20480},"sections":[{"key":"key_findings","heading":"Key Findings","basis":"document","body_markdown":" Found *it*. ","pages":[1,2,4],"evidence":[{"page":2,"quote":"q one"}],"supported":true},{"key":"other","heading":"Other","basis":"mixed","body_markdown":"Text","pages":[],"evidence":[],"supported":false}],"metrics":[{"label":"Rate","value":"87.5%","pages":[2],"verified":true},{"label":"No","value":"9","pages":[],"verified":false}],"references":[{"page":2,"quotes":["q one"],"used_in":["Key Findings"]}],"not_stated":["Date / year"],"validation_notes":[],"warnings":["one page had no text"],"meta":{"model":"m","strategy":"single-pass"}}"""

PAPER = [("a", 1, "Slow Rivers of the North\nAnn Lund and Bo Frey, 2019\nWe measured eleven rivers in winter."), ("a", 2, "The mean flow fell by 41.2% against the year before."), ("a", 3, "Ice cover lasted for 87 days at the upper station."), ("b", 1, "Another text altogether, with 12 numbers.")]
RAW = """{"overview":{"title":"Slow Rivers of the North","authors":["Ann Lund","Dr. Nobody"],"date":"2019","document_type":"Paper"},
"sections":[{"key":"made_up","heading":"","basis":"sure","body_markdown":"Flow fell, see page 2 and pp. 900-901.","pages":["2-3",999,true],"evidence":[{"page":3,"quote":"mean flow fell by 41.2% against"},{"quote":"Ice cover lasted for 87 days"},{"page":1,"quote":"This sentence is in no page at all."}]},
{"key":"methodology","heading":"Methods","basis":"document","body_markdown":"Nobody knows.","pages":[],"evidence":[]},{"key":"key_findings","heading":"Empty","body_markdown":" "}],
"metrics":[{"label":"Fall","value":"41.2%","pages":[1]},{"label":"Made up","value":"99.987%","pages":[1]},{"label":"Days","value":"87","pages":[3]}],"not_stated":["Funding"]}"""


def values(rows: list[tuple]) -> str:
    """Rows as an SQL VALUES list."""
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def sql_query(sql: str):
    """As query(), with the rows that must come out as SQL."""

    def add(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(spark)
        ORACLE[function.__name__] = sql
        return function

    return add


def _report(spark: SparkSession) -> DataFrame:
    return read_reports(spark.createDataFrame([("a", REPORT)], "doc string, body string"))


def _validated(spark: SparkSession) -> DataFrame:
    index = G.page_index(spark.createDataFrame(PAPER, "doc string, page_no int, text string"))
    docs = spark.createDataFrame([("a", "a.pdf", 2048, 3), ("b", "b.pdf", 10, 1)], "doc string, filename string, size_bytes long, page_count int")
    docs = docs.withColumns({"metadata": F.lit(None).cast("map<string,string>"), "warnings": F.array().cast("array<string>"), "meta": F.lit(None).cast("map<string,string>")})
    return V.validate_reports(index, spark.createDataFrame([("a", RAW), ("b", "no JSON")], "doc string, raw string"), docs)


#: REPORT as it must be rendered.
RENDERED = """# A | B

## Document Overview

| Field | Value |
|---|---|
| Title | A / B (from filename; no title found in text) |
| Author(s) | Ann, Bo |
| Date / year | Not stated in the document. |
| Document type | Paper |
| Pages | 4 |
| File | a.pdf (20 KB) |

## Key Findings

*Basis: Document content* · *Source: Pages 1–2, 4*

Found *it*.

**Supporting quotes (verified verbatim against the PDF):**

> “q one” — Page 2

## Other

*Basis: Document content with AI interpretation* · *⚠ No verifiable page reference — treat with caution*

Text

## Important Data / Metrics

| Metric | Value | Source | Verified |
|---|---|---|---|
| Rate | 87.5% | Page 2 | yes |
| No | 9 | — | NOT FOUND in PDF |

## Not Stated in the Document

- Date / year: Not stated in the document.

## Source References

- **Page 2** — used in: Key Findings
    - “q one”

## Verification Notes

- All page references and quotes were verified against the PDF; nothing needed correcting.
- Coverage note: one page had no text

---
*Generated  by m (single-pass, 0 chunk(s), 0 LLM call(s)) from the uploaded file a.pdf. Sections marked as AI interpretation are not statements by the document.*
"""
TEXT = """A  |  B

Document Overview

Field  |  Value
Title  |  A / B (from filename; no title found in text)
Author(s)  |  Ann, Bo
Date / year  |  Not stated in the document.
Document type  |  Paper
Pages  |  4
File  |  a.pdf (20 KB)
Key Findings

Basis: Document content · Source: Pages 1–2, 4

Found it.

Supporting quotes (verified verbatim against the PDF):

    “q one” — Page 2

Other

Basis: Document content with AI interpretation · ⚠ No verifiable page reference — treat with caution

Text

Important Data / Metrics

Metric  |  Value  |  Source  |  Verified
Rate  |  87.5%  |  Page 2  |  yes
No  |  9  |  —  |  NOT FOUND in PDF
Not Stated in the Document

- Date / year: Not stated in the document.

Source References

- Page 2 — used in: Key Findings
    - “q one”

Verification Notes

- All page references and quotes were verified against the PDF; nothing needed correcting.
- Coverage note: one page had no text

------------------------------------------------------------
Generated  by m (single-pass, 0 chunk(s), 0 LLM call(s)) from the uploaded file a.pdf. Sections marked as AI interpretation are not statements by the document.
"""


@sql_query(f"WITH q(doc, page_no, ord, quote) AS (VALUES {values(QUOTES)}), f AS (SELECT doc, page_no, quote, min(ord) AS ord, {NORM_SQL.format('quote')} AS norm FROM q GROUP BY doc, page_no, quote) SELECT doc, page_no, ord, quote FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.doc = f.doc AND o.page_no = f.page_no AND o.quote <> f.quote AND contains(o.norm, f.norm))")
def fragment_dedupe(spark: SparkSession) -> DataFrame:
    return G.drop_fragments(spark.createDataFrame(QUOTES, "doc string, page_no int, ord int, quote string"))


@sql_query("SELECT * FROM (VALUES (1, '1,2,3,4', 3), (2, '3', 0), (3, '1,2', 0), (4, '', 0), (5, '', 3), (6, '', 0), (7, '', 0)) t(id, pages, dropped)")
def page_coerce(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(COERCE, "id int, raw string").withColumn("x", T.coerce_pages(F.parse_json("raw"), F.array(*map(F.lit, (1, 2, 3, 4)))))
    return rows.select("id", F.array_join("x.pages", ",").alias("pages"), "x.dropped")


@sql_query("""SELECT * FROM (VALUES ('a', 0, 'Removed 3 page reference(s) that do not exist in this 3-page PDF.'), ('a', 1, 'Removed author “Dr. Nobody”: not found in the PDF''s opening pages or metadata.'), ('a', 2, 'Corrected a quote''s page in “Other” from 3 to 2.'), ('a', 3, 'Added the correct page (3) to an uncited quote in “Other”.'), ('a', 4, 'Removed a quote in “Other” that does not appear in the PDF.'), ('a', 5, 'Section “Methods” makes document claims but cites no valid page; flagged as unsupported.'), ('a', 6, 'Corrected pages for metric “Fall” to [2].'), ('a', 7, 'Metric “Made up” (value 99.987%) could not be found in the PDF; marked unverified.')) t(doc, place, note)""")
def validation_notes(spark: SparkSession) -> DataFrame:
    return _validated(spark).select("doc", F.posexplode("report.validation_notes").alias("place", "note"))


@sql_query("SELECT * FROM (VALUES ('a', 'methodology', '', false, 0), ('a', 'other', '2,3', true, 2)) t(doc, key, pages, supported, n_quotes)")
def validated_sections(spark: SparkSession) -> DataFrame:
    rows = _validated(spark).select("doc", F.explode("report.sections").alias("s"))
    return rows.select("doc", "s.key", F.array_join("s.pages", ",").alias("pages"), "s.supported", F.size("s.evidence").alias("n_quotes"))


@sql_query(must_be("doc string, stem string, body string", [("a", "a", RENDERED)]))
def report_markdown(spark: SparkSession) -> DataFrame:
    return R.rendered(_report(spark), "md")


@sql_query(must_be("doc string, stem string, body string", [("a", "a", TEXT)]))
def report_text(spark: SparkSession) -> DataFrame:
    return R.rendered(_report(spark), "txt")


@sql_query(must_be("doc string, stem string, body string", [("a", "a", json.dumps(json.loads(REPORT), indent=2, ensure_ascii=False))]))
def report_json(spark: SparkSession) -> DataFrame:
    return R.rendered(_report(spark), "json")


@sql_query("SELECT * FROM (VALUES ('a', 1, 1, 'Main Title Here', 1), ('a', 1, 3, 'Methods', 2), ('a', 1, 4, 'Bold lead', 3)) t(doc, page_no, line_no, text, level)")
def heading_levels(spark: SparkSession) -> DataFrame:
    return P.headings(spark.createDataFrame(LINES, "doc string, page_no int, line_no int, size double, text string, bold boolean"))


@sql_query("SELECT * FROM (VALUES ('a', 1, 0, 1), ('a', 1, 3, 2), ('a', 1, 1, 3), ('a', 1, 2, 4), ('a', 1, 4, 5), ('a', 1, 6, 6), ('a', 1, 5, 7), ('b', 1, 1, 1), ('b', 1, 0, 2)) t(doc, page_no, stream_pos, place)")
def column_order(spark: SparkSession) -> DataFrame:
    blocks = spark.createDataFrame(BLOCKS, "doc string, page_no int, stream_pos int, x0 double, y0 double, x1 double, y1 double, text string")
    return P.column_order(blocks.withColumn("width", F.lit(600.0)))


@sql_query("SELECT id, CAST(seconds AS DOUBLE) AS seconds FROM (VALUES (1, 7.0), (2, 63.0), (3, 3.7), (4, 0.75), (5, 10.0), (6, 65.0), (7, 20.5)) t(id, seconds)")
def retry_delay_parse(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(DELAYS, "id int, header string, message string")
    return rows.select("id", T.retry_delay(F.col("header"), F.col("message")).alias("seconds"))
