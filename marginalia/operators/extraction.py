"""From raw files and pages to a document that can be analysed: quarantine, OCR results, bibliography, page text from blocks.

A page is (doc, page_no, text). Nothing here ends a job: what is refused stays as a row with an error code and a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import pages as P
from marginalia.operators.numbering import sized
from marginalia.sources.tables import kept

# Limits, headings of bibliographies and what may end one, and messages.
MAX_PAGES, MAX_OCR_PAGES, MAX_OUTLINE, SHOWN_PAGES, SHOWN_HEADINGS, SHOWN_OCR = 300, 60, 200, 15, 40, 20
ROTATED, DISORDER = 0.98, 0.3
BIBLIOGRAPHY = r"(?md)^[ \t]*(?:\d{1,2}\.?|[IVX]{1,4}\.)?[ \t]*(?:References|REFERENCES|Bibliography|BIBLIOGRAPHY|Literature Cited|REFERENCES AND NOTES)[ \t]*$"
BIBLIOGRAPHY_END = r"(?md)^[ \t]*(?:Appendix|APPENDIX|Appendices|APPENDICES|Supplementary Material|SUPPLEMENTARY MATERIAL)\b"
HEADING_NUMBER = r"^(?:[A-Z]|\d+|[A-Z0-9]+(?:\.\d+)+\.?)$"
GARBLED = "This PDF's text layer is unreadable (its fonts have no character mapping), so the text cannot be extracted reliably."
SCAN = "No text could be extracted. This PDF looks like a scan or image-only document."
OCR_TRIED = " OCR was attempted but did not produce readable text."
OCR_ABSENT = " OCR is not available on this server (install Tesseract to enable it)."
DAMAGED = "The PDF's pages could not be read; the file is likely damaged."
BROKEN_PAGES, OCR_CAPPED = " page(s) could not be read and were skipped.", "Only the first {} unreadable pages were OCR'd (MAX_OCR_PAGES)."
METADATA_KEYS = ("title", "author", "creationDate", "subject")


def structural_error(files: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """files (…, error_code, readable, needs_password, page_count) with the first reason against each, content checks before structure."""
    structure = (
        F.when(~F.col("readable"), F.lit("corrupt"))
        .when(F.col("needs_password"), F.lit("encrypted"))
        .when(F.col("page_count") == 0, F.lit("empty"))
        .when(F.col("page_count") > max_pages, F.lit("too_many_pages"))
    )
    return files.withColumn("error_code", F.coalesce("error_code", structure))


def outline(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """doc, headings: the first MAX_OUTLINE entries (doc, pos, level, title, page) with a title and a page that the document (doc, page_count) has."""
    rows = entries.join(documents.select("doc", "page_count"), "doc").filter((F.trim("title") != "") & F.col("page").between(1, F.col("page_count")))
    listed = F.array_sort(F.collect_list(F.struct("pos", "level", F.trim("title").alias("title"), "page")))
    return rows.groupBy("doc").agg(F.transform(F.slice(listed, 1, MAX_OUTLINE), lambda x: F.struct(x["title"], x["level"], x["page"])).alias("headings"))


def told_metadata(metadata: Column) -> Column:
    """A map of strings without blank values, trimmed."""
    return F.map_filter(F.transform_values(metadata, lambda k, v: F.regexp_replace(v, r"^\s+|\s+$", "")), lambda k, v: v.isNotNull() & (v != ""))


# ------------------------------------------------------------------ text of a page
def block_texts(spans: DataFrame) -> DataFrame:
    """doc, page_no, stream_pos, text of the blocks of spans (doc, page_no, stream_pos, line_no, span_no, is_text, dx, text): rotated and blank lines are left out."""
    spans = spans.filter(F.col("is_text") & (F.col("dx") >= ROTATED))
    ordered = lambda number: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, "text"))), lambda x: x["text"]), "" if number == "span_no" else "\n")
    lines = spans.groupBy("doc", "page_no", "stream_pos", "line_no").agg(ordered("span_no").alias("text")).filter(F.regexp_replace("text", r"\s", "") != "")
    return lines.groupBy("doc", "page_no", "stream_pos").agg(ordered("line_no").alias("text"))


def page_texts(blocks: DataFrame) -> DataFrame:
    """doc, page_no, text of blocks (doc, page_no, stream_pos, x0, y0, x1, y1, width, height, text): in stream order, or by columns if the stream jumps about."""
    placed = blocks.join(P.column_order(blocks), ["doc", "page_no", "stream_pos"]).join(P.stream_disorder(blocks), ["doc", "page_no"])
    order = F.when(F.col("disorder") > DISORDER, F.col("place")).otherwise(F.col("stream_pos"))
    return placed.groupBy("doc", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), "text"))), lambda x: x["text"]), "\n\n").alias("text"))


# ------------------------------------------------------------------ readable pages
def with_ocr(pages: DataFrame, most: int = MAX_OCR_PAGES) -> DataFrame:
    """pages (doc, page_no, text, ocr_text) with the text to use, ocr and still_bad.

    ocr_text is what OCR gave, null where it failed or wasn't there. Of a document's unreadable pages the first `most` may take theirs, if that can be read.
    Pages are scored once; documents' values meet them by a broadcast, if they are few.
    """
    rows = kept(pages.withColumn("text", F.coalesce("text", F.lit(""))).withColumns(P.scores()), "scored-pages")  # a page that couldn't be read has none
    scored = P.judged(rows, sized(kept(P.doc_qualities(rows), "doc-qualities")))
    tried = sized(kept(scored.filter("not readable").groupBy("doc").agg(F.slice(F.array_sort(F.collect_list("page_no")), 1, most).alias("tried")), "ocr-tried"))
    good = (F.length(T.stripped(F.col("ocr_text"))) >= P.MIN_CHARS) & (T.text_quality(F.col("ocr_text")) >= P.GARBLED_PAGE)
    done = ~F.col("readable") & F.coalesce(F.array_contains("tried", F.col("page_no")) & good, F.lit(False))
    rows = scored.join(tried, "doc", "left").withColumn("ocr", done)
    return rows.select("doc", "page_no", F.when(F.col("ocr"), F.col("ocr_text")).otherwise(F.col("text")).alias("text"), "ocr", (~F.col("readable") & ~F.col("ocr")).alias("still_bad"))


def final_pages(pages: DataFrame) -> DataFrame:
    """pages of with_ocr() cleaned, without running headers and footers, with has_text."""
    tidied = pages.withColumn("text", T.page_tidy("text"))
    cleaned = P.strip_known_edges(kept(tidied.withColumn("edges", P.edge_keys(F.col("text"))), "clean-pages"))
    return cleaned.withColumn("has_text", (F.length("text") >= P.MIN_CHARS) & ~F.col("still_bad"))


def document_status(raw: DataFrame, final: DataFrame, ocr_available: bool, most: int = MAX_OCR_PAGES) -> DataFrame:
    """doc, n_pages, n_text, error, warnings: what a document's raw pages (doc, page_no, text, null where it couldn't be read) and final pages (has_text, ocr, still_bad) come to."""
    garbled = raw.groupBy("doc").agg(F.max(F.length(T.stripped(F.coalesce("text", F.lit("")))) >= P.MIN_CHARS).alias("garbled"), F.count_if(F.col("text").isNull()).alias("n_broken"))
    numbers = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("page_no"))))
    docs = final.groupBy("doc").agg(F.count("*").alias("n_pages"), F.count_if("has_text").alias("n_text"), numbers(~F.col("has_text")).alias("missing"), F.count_if("ocr").alias("n_ocr"), F.count_if(F.col("ocr") | F.col("still_bad")).alias("n_bad")).join(garbled, "doc", "left")
    hint = OCR_TRIED if ocr_available else OCR_ABSENT
    broken = F.when(F.col("n_broken") > 0, F.concat(F.col("n_broken").cast("string"), F.lit(BROKEN_PAGES)))
    capped = F.when(F.lit(ocr_available) & (F.col("n_bad") > most), F.lit(OCR_CAPPED.format(most)))
    error = F.when(F.col("n_broken") == F.col("n_pages"), F.lit(DAMAGED)).when(F.col("n_text") == 0, F.concat(F.when(F.coalesce("garbled", F.lit(False)), F.lit(GARBLED)).otherwise(F.lit(SCAN)), F.lit(hint)))
    shown = F.concat(F.array_join(F.slice("missing", 1, SHOWN_PAGES), ", "), F.when(F.size("missing") > SHOWN_PAGES, F.lit("...")).otherwise(F.lit("")))
    read = F.when(F.col("n_ocr") > 0, F.concat(F.col("n_ocr").cast("string"), F.lit(" page(s) had no usable text layer and were read with OCR; expect occasional recognition errors on those pages.")))
    lost = F.when(F.size("missing") > 0, F.concat(F.size("missing").cast("string"), F.lit(" page(s) had no readable text (blank, image-only or unreadable fonts) and are not covered by the analysis: "), shown, F.lit(".")))
    return docs.select("doc", "n_pages", "n_text", error.alias("error"), F.when(error.isNull(), F.array_compact(F.array(broken, capped, read, lost))).otherwise(F.array().cast("array<string>")).alias("warnings"))


# ------------------------------------------------------------------ bibliography
def hidden_before(text: Column, at: Column) -> Column:
    """text with what stands before an offset made unfindable; line feeds and offsets stay."""
    return F.concat(F.regexp_replace(F.substring(text, F.lit(1), at), r"[^\n]", "\u0001"), F.substring(text, at + 1, F.length(text)))


def heading_offset(text: Column, heading: Column, start: Column) -> Column:
    """Where a heading begins a line of text at or behind start, over line breaks and without its number if need be; null if nowhere."""
    words = F.filter(F.split(heading, r"\s+"), lambda w: w != "")
    seen = hidden_before(text, start)

    def place(some: Column) -> Column:
        pattern = F.concat(F.lit(r"(?md)^[ \t]*"), F.array_join(F.transform(some, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+"))
        found = F.regexp_instr(seen, pattern)
        return F.when((F.length(F.array_join(some, " ")) >= 4) & (found > 0), found - 1)

    short = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.coalesce(place(words), F.when((F.size(words) > 1) & F.rlike(F.get(words, 0), F.lit(HEADING_NUMBER)), place(short)))


def bibliography_spans(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """doc, page_no, begin, end: what of each page (doc, page_no, text, has_text) is bibliography, by offsets.

    It begins at the last line that is a bibliography's heading in the second half of a document of three text pages or more, and ends at the
    first appendix line or heading (doc, page_no, heading) behind it, or with the document.
    """
    text = pages.filter("has_text").select("doc", "page_no", "text")
    numbers = text.groupBy("doc").agg(F.array_sort(F.collect_list("page_no")).alias("p")).filter(F.size("p") >= 3)
    half = sized(kept(numbers.select("doc", F.element_at("p", F.floor(F.size("p") / 2).cast("int") + 1).alias("half")), "halves"))
    last = F.length(F.regexp_extract("text", rf"(?s)\A(.*)(?-s:{BIBLIOGRAPHY})", 1))  # the greedy part ends at the last match
    begun = text.join(half, "doc").filter((F.col("page_no") >= F.col("half") - 1) & F.col("text").rlike(BIBLIOGRAPHY))
    starts = begun.groupBy("doc").agg(F.max(F.struct("page_no", last.alias("at"))).alias("x")).select("doc", F.col("x.page_no").alias("first"), F.col("x.at").alias("at"))
    starts = sized(kept(starts, "bibliography-starts"))
    spanned = text.join(starts, "doc").filter("page_no >= first").withColumn("begin", F.when(F.col("page_no") == F.col("first"), F.col("at")).otherwise(F.lit(0)))
    appendix = F.regexp_instr(hidden_before(F.col("text"), F.col("begin")), F.lit(BIBLIOGRAPHY_END))
    title = F.trim("heading")
    known = headings.select("doc", "page_no", title.alias("heading")).filter((F.length("heading") >= 4) & ~F.col("heading").rlike(BIBLIOGRAPHY))
    after = F.when(F.col("page_no") == F.col("first"), F.col("begin") + 1).otherwise(F.lit(0))
    placed = spanned.join(known, ["doc", "page_no"]).withColumn("place", heading_offset(F.col("text"), F.col("heading"), after))
    ends = placed.groupBy("doc", "page_no").agg(F.min("place").alias("by_heading"))
    both = spanned.join(ends, ["doc", "page_no"], "left").withColumn("stop", F.least("by_heading", F.when(appendix > 0, appendix - 1)))
    until = both.filter("stop is not null").groupBy("doc").agg(F.min("page_no").alias("until"))
    rows = both.join(until, "doc", "left").filter(F.col("until").isNull() | (F.col("page_no") <= F.col("until")))
    return rows.select("doc", "page_no", "begin", F.coalesce("stop", F.length("text")).alias("end"))


def without_bibliography(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """pages with analysis_text: what goes to the analysis."""
    spans = sized(kept(bibliography_spans(pages, headings), "bibliography"))
    left = F.concat(F.substring("text", F.lit(1), F.col("begin")), F.substring("text", F.col("end") + 1, F.length("text")))
    joined = pages.join(spans, ["doc", "page_no"], "left")
    return joined.withColumn("analysis_text", F.when(F.col("begin").isNull(), F.col("text")).otherwise(T.stripped(left))).drop("begin", "end")


# ------------------------------------------------------------------ what an annotator is told
def full_texts(pages: DataFrame) -> DataFrame:
    """doc, text: all pages (doc, page_no, analysis_text, has_text) that go to the analysis, marked, in order."""
    told = pages.filter(F.col("has_text") & (T.stripped(F.col("analysis_text")) != ""))
    block = F.struct("page_no", F.concat(T.page_marker(F.col("page_no")), F.lit("\n"), F.col("analysis_text")).alias("block"))
    return told.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["block"]), "\n\n").alias("text"))


def described(docs: DataFrame) -> DataFrame:
    """doc, description of docs (doc, filename, page_count, n_text, metadata, headings, reference_pages, ocr_pages)."""
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.try_element_at("metadata", F.lit(k)).alias("v")) for k in METADATA_KEYS)), lambda x: x["v"].isNotNull())
    quoted = lambda v: F.concat(F.lit("'"), v, F.lit("'"))
    meta = F.array_join(F.transform(pairs, lambda x: F.concat(x["k"], F.lit("="), quoted(x["v"]))), ", ")
    heads = F.array_join(F.transform(F.slice("headings", 1, SHOWN_HEADINGS), lambda h: F.concat(h["title"], F.lit(" (p."), h["page"].cast("string"), F.lit(")"))), "; ")
    or_else = lambda c, other: F.when(c == "", F.lit(other)).otherwise(c)
    number = lambda c: c.cast("string")
    cited = F.when(F.size("reference_pages") > 0, F.concat(F.lit("The bibliography (pages "), number(F.array_min("reference_pages")), F.lit("-"), number(F.array_max("reference_pages")), F.lit(") is omitted from the text below.")))
    read = F.when(F.size("ocr_pages") > 0, F.concat(F.lit("Pages ["), F.array_join(F.slice("ocr_pages", 1, SHOWN_OCR), ", "), F.lit("] were read with OCR and may contain recognition errors; do not quote garbled text.")))
    notes = F.concat_ws(" ", cited, read)
    lines = [
        F.concat(F.lit("Filename: "), F.col("filename")),
        F.concat(F.lit("Total pages: "), number(F.col("page_count")), F.lit(" (pages with extractable text: "), number(F.col("n_text")), F.lit(")")),
        F.concat(F.lit("Embedded PDF metadata (may be missing or wrong): "), or_else(meta, "none")),
        F.concat(F.lit("Detected headings/outline: "), or_else(heads, "none detected")),
        F.nullif(notes, F.lit("")),
    ]
    return docs.select("doc", F.concat_ws("\n", *lines).alias("description"))
