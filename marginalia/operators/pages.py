"""Operators on pages, lines and layout blocks. A page is (doc, page_no, text)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from marginalia.functions import text as T
from marginalia.operators.greedy import members, runs
from marginalia.operators.numbering import numbered, sized
from marginalia.sources.tables import kept

MIN_CHARS, GARBLED_PAGE, GARBLED_DOC = 25, 0.2, 0.3
EDGE_LINES, EDGE_CHARS, HEADER_SHARE, HEADER_PAGES, HEADER_MIN = 2, 80, 0.5, 4, 3
CHUNK_CHARS, SINGLE_PASS_CHARS = 30_000, 100_000
#: Characters of a block at least: the marker, a line feed and one more.
LEAST_BLOCK = 12
#: Blocks, three numbers each, whose places are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 1_000_000


def upper_median(name: str) -> Column:
    """An aggregate: the greater of the two middle values of a column. It holds counts of distinct values, not rows."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")


def scores() -> dict[str, Column]:
    """n_chars and quality of a text."""
    return T.page_scores(F.col("text"))


def doc_qualities(page: DataFrame) -> DataFrame:
    """doc, doc_quality: the upper median of the scores of pages with enough text."""
    return page.filter(F.col("n_chars") >= MIN_CHARS).groupBy("doc").agg(upper_median("quality").alias("doc_quality"))


def scored(pages: DataFrame) -> DataFrame:
    """Adds scores(), doc_quality and readable."""
    return judged(pages.withColumns(scores()))


def judged(page: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Pages with scores(), and doc_quality and readable. docs: doc_qualities() of the pages, if they are known."""
    docs = doc_qualities(page) if docs is None else docs
    bad = (F.col("n_chars") < MIN_CHARS) | (F.col("quality") < GARBLED_PAGE) | (F.coalesce("doc_quality", F.lit(0.0)) < GARBLED_DOC)
    return page.join(docs, "doc", "left").withColumn("readable", ~bad)


def edge_lines(pages: DataFrame, edge: int = EDGE_LINES) -> DataFrame:
    """doc, page_no, pos, line, key: the first and last non-blank lines of each page, if short."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda x: F.trim(x["line"]) != "")
    ends = F.array_distinct(F.concat(F.slice("kept", 1, edge), F.slice("kept", F.greatest(F.size("kept") - edge + 1, F.lit(1)), edge)))
    rows = pages.withColumn("kept", kept).filter(F.size("kept") > 0).select("doc", "page_no", F.explode(ends).alias("x")).select("doc", "page_no", "x.pos", "x.line")
    return rows.filter(F.length(F.trim("line")) <= EDGE_CHARS).withColumn("key", T.line_key(F.col("line")))


def frequent_keys(lines: DataFrame, pages: DataFrame, share: float) -> DataFrame:
    """doc, key, n_pages of edge lines that are on enough pages."""
    counts = lines.groupBy("doc", "key").agg(F.countDistinct("page_no").alias("n_pages"))
    sizes = pages.groupBy("doc").agg(F.count("*").alias("n_all"))
    limit = F.greatest(F.lit(HEADER_MIN), F.floor(F.col("n_all") * share))
    return counts.join(sizes, "doc").filter((F.col("n_all") >= HEADER_PAGES) & (F.col("n_pages") >= limit)).select("doc", "key", "n_pages")


def repeated_edge_lines(pages: DataFrame, share: float = HEADER_SHARE) -> DataFrame:
    """doc, key, n_pages: running headers and footers."""
    return frequent_keys(edge_lines(pages), pages, share)


def repeated_places(pages: DataFrame, share: float = HEADER_SHARE) -> DataFrame:
    """doc, page_no, gone: where a page's running headers and footers stand. The edge lines are computed once and kept."""
    lines = kept(edge_lines(pages).select("doc", "page_no", "pos", "key"), "edge-lines")
    return lines.join(frequent_keys(lines, pages, share), ["doc", "key"], "left_semi").groupBy("doc", "page_no").agg(F.collect_set("pos").alias("gone"))


def strip_repeated_lines(pages: DataFrame, share: float = HEADER_SHARE, places: DataFrame | None = None) -> DataFrame:
    """pages with running headers and footers removed from the edges."""
    gone = repeated_places(pages, share) if places is None else places
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return pages.join(gone, ["doc", "page_no"], "left").withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(T.stripped(left))).drop("gone")


def edge_keys(text: Column, edge: int = EDGE_LINES) -> Column:
    """An array of pos and key: the edge_lines() of one text."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda x: F.trim(x["line"]) != "")
    ends = T.let(lines, lambda k: F.array_distinct(F.concat(F.slice(k, F.lit(1), F.lit(edge)), F.slice(k, F.greatest(F.size(k) - edge + 1, F.lit(1)), F.lit(edge)))))
    return F.transform(F.filter(ends, lambda x: F.length(F.trim(x["line"])) <= EDGE_CHARS), lambda x: F.struct(x["pos"].alias("pos"), T.line_key(x["line"]).alias("key")))


def strip_known_edges(pages: DataFrame, share: float = HEADER_SHARE) -> DataFrame:
    """strip_repeated_lines() of pages with their edge_keys() as `edges`, which goes.

    A document has few keys that are on half of its pages, so pages meet them by document and no text is moved for them.
    """
    lines = pages.select("doc", "page_no", F.explode("edges").alias("x")).select("doc", "page_no", "x.key")
    keys = kept(frequent_keys(lines, pages, share).groupBy("doc").agg(F.collect_set("key").alias("repeated")), "repeated-keys")
    joined = pages.join(sized(keys), "doc", "left").withColumn("gone", F.transform(F.filter("edges", lambda e: F.array_contains("repeated", e["key"])), lambda e: e["pos"]))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return joined.withColumn("text", F.when(F.coalesce(F.size("gone"), F.lit(0)) > 0, T.stripped(left)).otherwise(F.col("text"))).drop("edges", "repeated", "gone")


#: A character that neither Spark nor Python takes for white space.
SOLID = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"


def strategies(pages: DataFrame, single: int = SINGLE_PASS_CHARS, most: int = CHUNK_CHARS, numbered_pages: Callable[[], DataFrame] | None = None) -> DataFrame:
    """doc, analysis_chars, n_pages, strategy: documents of at most `single` characters, or of one chunk, go in a single pass.

    A longer document comes to one chunk only if nearly all of it is blank, so only such documents are cut to see; numbered_pages() gives their pages if `pages` have no numbers.
    """
    n = F.length("text")
    solid = F.when(F.col("text").rlike(SOLID), F.when(n <= most, n).otherwise(F.lit(1)))  # at least so much of a page is in blocks
    docs = pages.groupBy("doc").agg(F.sum(n).alias("analysis_chars"), F.count("*").alias("n_pages"), F.coalesce(F.sum(solid), F.lit(0)).alias("solid"), F.count(solid).alias("n_solid"))
    docs = kept(docs, "doc-sizes")
    blank = docs.filter((F.col("analysis_chars") > single) & ((F.col("solid") <= most) | (F.col("n_solid") <= 1)))
    docs = docs.drop("solid", "n_solid")
    if blank.limit(1).count():
        every = pages if numbered_pages is None else numbered_pages()
        one = chunks(every.join(blank, "doc", "left_semi"), most).groupBy("doc").agg(F.count("*").alias("n_chunks")).filter("n_chunks <= 1")
    else:
        one = docs.select("doc", F.lit(1).alias("n_chunks")).limit(0)
    marked = docs.join(one, "doc", "left")
    return marked.withColumn("strategy", F.when((F.col("analysis_chars") <= single) | F.col("n_chunks").isNotNull(), F.lit("single-pass")).otherwise(F.lit("map-reduce"))).drop("n_chunks")


def split_long(text: str, most: int) -> list[str]:
    """Pieces of at most `most` characters, in order: by paragraph, else by sentence, else hard."""
    import re

    out, buffer = [], ""

    def put(piece: str, glue: str) -> None:
        nonlocal buffer
        if buffer and len(buffer) + len(glue) + len(piece) > most:
            out.append(buffer)
            buffer = ""
        buffer = f"{buffer}{glue}{piece}" if buffer else piece

    if len(text) <= most:
        return [text]
    for paragraph in re.split(r"\n{2,}|\n(?=[A-Z0-9])", text):
        if len(paragraph) <= most:
            put(paragraph, "\n\n")
            continue
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            for at in range(0, len(sentence), most):
                put(sentence[at : at + most], " ")
    return [p.strip() for p in [*out, buffer] if p.strip()]


@F.pandas_udf(ArrayType(StringType()))
def _split_udf(text: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else split_long(t, int(n)) for t, n in zip(text, most)], dtype=object)


def piece_lengths(most: int = CHUNK_CHARS) -> Column:
    """The lengths of the pieces of a text that blocks() makes; null for a blank one."""
    long = F.transform(_split_udf(F.when(F.length("text") > most, F.col("text")), F.lit(most)), lambda x: F.length(x))
    return F.when(T.stripped(F.col("text")) != "", F.coalesce(long, F.array(F.length("text"))))


def blocks(pages: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """doc, page_no, piece, block: marked pages that aren't blank, long ones in pieces of at most `most` characters."""
    pieces = F.coalesce(_split_udf(F.when(F.length("text") > most, F.col("text")), F.lit(most)), F.array("text"))
    rows = pages.filter(T.solid(F.col("text"))).select("doc", "page_no", F.posexplode(pieces).alias("piece", "body"))
    return rows.select("doc", "page_no", "piece", F.concat(T.page_marker(F.col("page_no")), F.lit("\n"), "body").alias("block"))


def chunks(pages: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """doc, chunk_idx, pages, text: whole marked pages packed in order; long pages are split.

    A document of any length spans tasks: its blocks are numbered by ranges, and what begins a chunk is found by pointers from segment to segment.
    Both take the blocks' lengths alone; a text is moved to its chunk when that is known.
    """
    every = kept(blocks(pages, most).withColumn("block_id", F.monotonically_increasing_id()), "chunk-blocks")
    costs = every.select("doc", "page_no", "piece", "block_id", F.length("block").cast("long").alias("cost"))
    costs = kept(numbered(costs, ["doc"], ["page_no", "piece"], "idx", "blocks").select("doc", "idx", "block_id", "cost"), "block-costs")
    found = runs(costs.select("doc", "idx", "cost"), most, gap=2, least_cost=LEAST_BLOCK)
    placed = kept(costs.join(members(found), ["doc", "idx"]).select("block_id", "idx", "run"), "block-runs")
    rows = every.join(sized(placed, BROADCAST_BLOCKS), "block_id").groupBy("doc", F.col("run").cast("int").alias("chunk_idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "page_no", "block"))).alias("x"))
    return rows.select("doc", "chunk_idx", F.array_distinct("x.page_no").alias("pages"), F.array_join("x.block", "\n\n").alias("text"))


def chunk_spans(pages: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """doc, chunk_idx, pages, n_chars of chunks(), from the piece_lengths() of pages (doc, page_no, lengths): no text is moved."""
    rows = pages.select("doc", "page_no", F.posexplode("lengths").alias("piece", "n"))
    costs = rows.select("doc", "page_no", "piece", (F.length(T.page_marker(F.col("page_no"))) + 1 + F.col("n")).cast("long").alias("cost"))
    every = kept(numbered(costs, ["doc"], ["page_no", "piece"], "idx", "blocks").select("doc", "page_no", "idx", "cost"), "chunk-costs")
    joined = every.join(members(runs(every.select("doc", "idx", "cost"), most, gap=2, least_cost=LEAST_BLOCK)), ["doc", "idx"])
    return joined.groupBy("doc", F.col("run").cast("int").alias("chunk_idx")).agg(F.sort_array(F.collect_set("page_no")).alias("pages"), (F.sum("cost") + 2 * (F.count("*") - 1)).cast("int").alias("n_chars"))


def page_packs(pages: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """doc, pack, first_page, last_page, n_chars: neighbouring pages packed whole, up to `most` characters of text; a longer page is a pack of its own."""
    rows = pages.select("doc", F.col("page_no").alias("idx"), F.length("text").cast("long").alias("cost")).filter("cost > 0")
    every = numbered(rows, ["doc"], ["idx"], "at", "packs").select("doc", F.col("at").alias("idx"), F.col("idx").alias("page_no"), "cost")
    joined = every.join(members(runs(every, most)), ["doc", "idx"])
    return joined.groupBy("doc", F.col("run").alias("pack")).agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.sum("cost").alias("n_chars"))


def headings(lines: DataFrame) -> DataFrame:
    """doc, page_no, line_no, text, level of font lines (doc, page_no, line_no, size, text, bold) that stand out, the first 200 of a document."""
    size = F.bround("size", 0)
    body = lines.groupBy("doc").agg(F.median("size").alias("body"))
    sized = lines.join(body, "doc").withColumn("big", F.col("size") >= 1.15 * F.col("body"))
    steps = sized.groupBy("doc").agg(F.sort_array(F.collect_set(F.when(F.col("big"), size)), False).alias("steps"))
    shape = F.length("text").between(3, 120) & ~F.col("text").rlike(r"(?U)\A[\d\W]+\z")
    bold = F.col("bold") & (F.col("size") >= 0.98 * F.col("body")) & (F.length("text") <= 70) & ~F.col("text").rlike("[.,]$")
    level = F.when(F.col("big"), F.array_position("steps", size)).otherwise(F.size("steps") + 1)
    found = sized.filter(shape & (F.col("big") | bold)).join(steps, "doc").withColumn("level", level.cast("int"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("page_no", "line_no"))
    return found.withColumn("rank", rank).filter("rank <= 200").select("doc", "page_no", "line_no", "text", "level")


def column_order(blocks: DataFrame) -> DataFrame:
    """blocks (doc, page_no, stream_pos, x0, y0, x1, y1, width, text) with their place in reading order.

    On two-column pages full-width blocks part the page into bands; in a band the left
    column goes before the right one. Other pages are read top to bottom.
    """
    mid = F.col("width") / 2
    spans = ((F.col("x1") - F.col("x0")) > 0.55 * F.col("width")) | ((F.col("x0") < mid - 0.08 * F.col("width")) & (F.col("x1") > mid + 0.08 * F.col("width")))
    side = F.when(spans, F.lit(2)).when((F.col("x0") + F.col("x1")) / 2 < mid, F.lit(0)).otherwise(F.lit(1))
    page = Window.partitionBy("doc", "page_no")
    placed = blocks.withColumn("side", side)
    share = lambda s: F.sum(F.when(F.col("side") == s, F.length("text")).otherwise(0)).over(page) / F.greatest(F.sum(F.length("text")).over(page), F.lit(1))
    above = page.orderBy("y0").rangeBetween(Window.unboundedPreceding, 0)
    band = F.sum(F.when(F.col("side") == 2, 1).otherwise(0)).over(above) - F.when(F.col("side") == 2, 1).otherwise(0)
    two = placed.withColumns({"two": (share(0) >= 0.15) & (share(1) >= 0.15), "band": band})
    place = Window.partitionBy("doc", "page_no").orderBy(F.when(F.col("two"), F.col("band")).otherwise(F.lit(0)), F.when(F.col("two"), F.col("side")).otherwise(F.lit(0)), F.when(F.col("two"), F.col("y0")).otherwise(F.bround("y0", 0)), "x0", "stream_pos")
    return two.select("doc", "page_no", "stream_pos", F.row_number().over(place).alias("place"))


def stream_disorder(blocks: DataFrame) -> DataFrame:
    """doc, page_no, disorder: share of neighbouring blocks of one column that jump up the page by over 15 % of its height."""
    mid = F.col("width") / 2
    spans = ((F.col("x1") - F.col("x0")) > 0.55 * F.col("width")) | ((F.col("x0") < mid - 0.08 * F.col("width")) & (F.col("x1") > mid + 0.08 * F.col("width")))
    side = F.when(spans, F.lit(2)).when((F.col("x0") + F.col("x1")) / 2 < mid, F.lit(0)).otherwise(F.lit(1))
    order = Window.partitionBy("doc", "page_no").orderBy("stream_pos")
    pairs = blocks.withColumn("side", side).withColumns({"next_side": F.lead("side").over(order), "next_y0": F.lead("y0").over(order)})
    same = F.coalesce((F.col("side") == F.col("next_side")) & (F.col("side") < 2), F.lit(False))
    n, jumps = F.sum(same.cast("int")), F.sum((same & (F.col("next_y0") < F.col("y0") - 0.15 * F.col("height"))).cast("int"))
    return pairs.groupBy("doc", "page_no").agg(F.when(n > 0, jumps / n).otherwise(F.lit(0.0)).alias("disorder"))
