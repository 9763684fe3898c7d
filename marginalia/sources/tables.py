"""Sources: the test tables as paged documents, raw files, and report JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.numbering import numbered
from marginalia.sources.shared import forget as forget
from marginalia.sources.shared import kept as kept
from marginalia.sources.shared import kept_once as kept_once

MAX_FILE_MB = 25
REPORT_SCHEMA = """overview struct<title:string,title_source:string,authors:array<string>,date:string,document_type:string,page_count:int,filename:string,size_bytes:bigint>,
sections array<struct<key:string,heading:string,basis:string,body_markdown:string,pages:array<int>,evidence:array<struct<page:int,quote:string>>,supported:boolean>>,
metrics array<struct<label:string,value:string,pages:array<int>,verified:boolean>>,
`references` array<struct<page:int,quotes:array<string>,used_in:array<string>>>,
not_stated array<string>, validation_notes array<string>, warnings array<string>, meta map<string,string>"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, text, doc_id: pages() without their numbers."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "text", "doc_id")


def pages(spark: SparkSession, sf_dir: str, **values: Column) -> DataFrame:
    """doc, page_no, text: a source is a document, its rows in order of id are the pages. A source of any share of the rows is numbered by ranges.

    With `values`, what is computed of each text where it is read takes the text's place, so texts aren't moved.
    """
    rows = unnumbered(spark, sf_dir)
    if values:
        rows = kept(rows.select("doc", *[c.alias(name) for name, c in values.items()], "doc_id"), "page-values")
    return numbered(rows, ["doc"], ["doc_id"], "page", "pages").select("doc", (F.col("page") + 1).cast("int").alias("page_no"), *[c for c in rows.columns if c != "doc"])


def file_error(content: Column, path: Column, size: Column, max_mb: int = MAX_FILE_MB) -> Column:
    """Why a raw file is refused, cheapest reason first; null if it isn't. The mark of a PDF stands in the first 1024 bytes, or behind leading white space."""
    early = F.contains(F.substring(content, 1, 1024), F.lit(b"%PDF-"))
    late = F.decode(content, "ISO-8859-1").rlike(r"\A[ \t\n\r\x0B\f]+%PDF-")
    return (
        F.when(content.isNull() | (size == 0), F.lit("no_file"))
        .when(~F.lower(path).endswith(".pdf"), F.lit("invalid_type"))
        .when(size > max_mb * 1024 * 1024, F.lit("too_large"))
        .when(~(early | late), F.lit("invalid_type"))
    )


#: What an upload is answered for each error.
UPLOAD_STATUS = {"no_file": 400, "invalid_type": 400, "too_large": 413, "rate_limited": 429, "too_many_active": 429, "busy": 503}


def upload_status(error: Column) -> Column:
    """202 for what is accepted."""
    out = F.lit(202)
    for code, status in UPLOAD_STATUS.items():
        out = F.when(error == code, F.lit(status)).otherwise(out)
    return out


def raw_files(spark: SparkSession, path: str, max_mb: int = MAX_FILE_MB) -> DataFrame:
    """path, content, size_bytes, sha256, error_code of every file; refused files stay as quarantine rows. Spark's reader itself leaves out files of no bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), file_error(F.col("content"), F.col("path"), F.col("length"), max_mb).alias("error_code"))


def file_stream(spark: SparkSession, path: str, per_trigger: int = 20) -> DataFrame:
    """New files as a stream, so many a trigger."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(path)


def read_reports(bodies: DataFrame) -> DataFrame:
    """Report structs from JSON (doc, body), lists and texts cut to their limits; a body that is no report, or has a field of a wrong type, has a null report.

    Of meta only single values of under 500 characters stay.
    """
    parsed = bodies.withColumn("report", F.from_json("body", REPORT_SCHEMA, {"mode": "PERMISSIVE"}))
    raw = F.try_parse_json("body")
    typed = F.coalesce(F.schema_of_variant(F.try_variant_get(raw, "$.overview.title", "variant")) == "STRING", F.lit(False)) & F.coalesce(F.schema_of_variant(F.try_variant_get(raw, "$.overview.filename", "variant")) == "STRING", F.lit(False)) & F.coalesce(F.schema_of_variant(F.try_variant_get(raw, "$.sections", "variant")).startswith("ARRAY"), F.lit(False))
    r = F.col("report")
    listed = lambda name, n: F.slice(F.coalesce(r[name], F.array()), 1, n)
    cut = lambda x, **sizes: reduce(lambda row, k: row.withField(k, F.substring(row[k], 1, sizes[k])), sizes, x)
    texts = lambda xs, n: F.transform(F.slice(F.coalesce(xs, F.array().cast("array<string>")), 1, 500), lambda t: F.substring(t, 1, n))
    numbers = lambda xs: F.slice(F.coalesce(xs, F.array().cast("array<int>")), 1, 500)
    basis = lambda s: F.when(s["basis"].isin("document", "interpretation", "mixed"), s["basis"]).otherwise(F.lit("mixed"))
    evidence = lambda s: F.transform(F.slice(F.coalesce(s["evidence"], F.array()), 1, 50), lambda e: cut(e, quote=500))
    section = lambda s: cut(s, key=40, heading=200, body_markdown=20_000).withField("basis", basis(s)).withField("pages", numbers(s["pages"])).withField("evidence", evidence(s)).withField("supported", F.coalesce(s["supported"], F.lit(True)))
    metric = lambda m: cut(m, label=300, value=200).withField("pages", numbers(m["pages"])).withField("verified", F.coalesce(m["verified"], F.lit(False)))
    reference = lambda x: x.withField("quotes", texts(x["quotes"], 500)).withField("used_in", texts(x["used_in"], 200))
    overview = cut(r["overview"], title=500, title_source=20, date=100, document_type=100, filename=255)
    overview = overview.withField("authors", texts(r["overview"]["authors"], 200)).withField("date", F.nullif(overview["date"], F.lit("")))
    whole = r.withField("overview", overview).withField("sections", F.transform(listed("sections", 40), section)).withField("metrics", F.transform(listed("metrics", 40), metric)).withField("references", F.transform(listed("references", 500), reference))
    for name, n in (("not_stated", 200), ("validation_notes", 500), ("warnings", 500)):
        whole = whole.withField(name, texts(r[name], n))
    single = F.map_filter(F.coalesce(r["meta"], F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (F.length(v) < 500) & ~v.rlike(r"^\s*[\[{]"))
    return parsed.withColumn("report", F.when(typed & r["overview"].isNotNull(), whole.withField("meta", single)))
