"""Checks of quotes, numbers and pages against the page text, and what a report makes of them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from marginalia.functions import text as T
from marginalia.operators.numbering import sized
from marginalia.sources.tables import kept, kept_once


def page_index(pages: DataFrame) -> DataFrame:
    """doc, page_no, norm of pages with text."""
    return pages.select("doc", "page_no", T.page_match_form("text").alias("norm")).filter("norm != ''")


def locate_quotes(index: DataFrame, quotes: DataFrame) -> DataFrame:
    """quote_id, doc, page_no: the first page of each document that holds a quote (quote_id, quote).

    A quote's words but the first and last are whole words of a page that holds it, so
    the longest of these leads to the pages by an equi-join of keys; a page's text joins its candidates alone. Quotes without such a word
    are found by the first three characters of their longest word, which every page that holds them has in a word of its own.
    """
    index, needles = kept(index, "index"), quotes.select("quote_id", T.match_form(F.col("quote")).alias("needle")).filter(F.length("needle") >= T.MIN_QUOTE)
    words = F.split("needle", " ")
    longest = lambda some: F.array_max(F.transform(some, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    needles = kept(needles.withColumns({"anchor": longest(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))), "part": F.substring(longest(words), 1, 3)}), "needles")
    page_words = index.select("doc", "page_no", F.explode(F.array_distinct(F.split("norm", " "))).alias("anchor"))
    keys = page_words.join(needles.filter("anchor is not null").select("anchor", "quote_id"), "anchor").select("quote_id", "doc", "page_no")
    short = needles.filter("anchor is null").select("part", "quote_id")
    if short.limit(1).count():
        spots = F.transform(F.sequence(F.lit(1), F.greatest(F.length("anchor") - 2, F.lit(1))), lambda i: F.substring(F.col("anchor"), i, F.lit(3)))
        parts = page_words.select("doc", "page_no", F.explode(F.array_distinct(spots)).alias("part")).distinct()
        keys = keys.unionByName(parts.join(short, "part").select("quote_id", "doc", "page_no"))
    found = keys.join(needles.select("quote_id", "needle"), "quote_id").join(index, ["doc", "page_no"]).filter(F.contains("norm", "needle"))
    return found.groupBy("quote_id", "doc").agg(F.min("page_no").alias("page_no"))


#: Needles, and bytes of page text, that meet in one task.
NEEDLES, SLICE_BYTES = 2000, 8 << 20


def _scan(first: bool, schema: StructType):
    """A cogrouped applyInArrow function: pages and needles of one document -> where the needles are, by one pass of an automaton over each page; with `first` the least page of each alone."""

    def run(pages: pa.Table, needles: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if pages.num_rows and needles.num_rows:
            doc, words, automaton = needles["doc"][0].as_py(), needles["needle"].to_pylist(), ahocorasick.Automaton()
            for i, word in enumerate(words):
                automaton.add_word(word, i)
            automaton.make_automaton()
            least: dict[int, int] = {}
            for page, norm in sorted(zip(pages["page_no"].to_pylist(), pages["norm"].to_pylist())):
                here = {i for _, i in automaton.iter(norm)}
                if first:
                    for i in here.difference(least):
                        least[i] = page
                else:
                    found += [(doc, words[i], page) for i in here]
            found += [(doc, words[i], page) for i, page in least.items()]
        return pa.table([pa.array([x[k] for x in found], to_arrow_type(f.dataType)) for k, f in enumerate(schema)], names=schema.names)

    return run


def needle_pages(index: DataFrame, needles: DataFrame, first: bool = False) -> DataFrame:
    """doc, needle, page_no: the pages (doc, page_no, norm) of its document that hold each needle (doc, needle; different ones), or the first of them.

    A document's needles are dealt out in parts and its pages in slices, so a task has a bounded number of each, and each page is read once for a whole part of needles.
    """
    wanted = needles.groupBy("doc").agg(F.ceil(F.count("*") / NEEDLES).alias("parts"))
    grid = index.groupBy("doc").agg(F.ceil(F.sum(F.octet_length("norm")) / SLICE_BYTES).alias("slices")).join(wanted, "doc")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = index.join(grid, "doc").withColumn("slice", F.pmod(F.xxhash64("page_no"), "slices")).withColumn("part", every("parts")).select("doc", "slice", "part", "page_no", "norm")
    right = needles.join(grid, "doc").withColumn("part", F.pmod(F.xxhash64("needle"), "parts")).withColumn("slice", every("slices"))
    right = right.select(F.col("doc"), F.col("slice").alias("of_slice"), F.col("part").alias("of_part"), "needle")
    schema = StructType([index.schema["doc"], StructField("needle", StringType()), index.schema["page_no"]])
    hits = left.groupBy("doc", "slice", "part").cogroup(right.groupBy("doc", "of_slice", "of_part")).applyInArrow(_scan(first, schema), schema)
    return hits.groupBy("doc", "needle").agg(F.min("page_no").alias("page_no")) if first else hits


#: Bytes of a gram, and neighbouring grams of which the least stands for all: any GRAM + WINDOW - 1 bytes have a gram in common with every text that holds them.
GRAM, WINDOW = 8, 8


def grams(text: bytes) -> np.ndarray:
    """The grams of a text, as hashes, that are the least of any WINDOW neighbours; those of a part of it of GRAM + WINDOW - 1 bytes or more are among them."""
    if len(text) < GRAM + WINDOW - 1:
        return np.zeros(0, np.int64)
    h = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), GRAM)).view(np.uint64).ravel()
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    for step in (1, 2, 4):
        h = np.minimum(h[:-step], h[step:])
    return np.unique(h).view(np.int64)


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's columns but the last, and an array of its grams."""
    for whole in batches:
        for at in range(0, whole.num_rows, GRAM_ROWS):
            batch = whole.slice(at, GRAM_ROWS)
            found = [grams(t.encode()) for t in batch.column(batch.num_columns - 1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "grams"])


#: Texts whose grams are made at a time.
GRAM_ROWS = 500


def _grams(rows: DataFrame, text: str) -> DataFrame:
    """rows without their text, a row for each of its grams."""
    keys = [c for c in rows.columns if c != text]
    schema = StructType([*[rows.schema[c] for c in keys], StructField("grams", ArrayType(LongType()))])
    return rows.select(*keys, text).mapInArrow(_gram_batches, schema).select(*keys, F.explode("grams").alias("gram"))


def first_pages(index: DataFrame, needles: DataFrame) -> DataFrame:
    """doc, needle, page_no: the first page (doc, page_no, norm) of its document that holds each needle (doc, needle; different ones of MIN_QUOTE characters or more).

    A page that holds a needle has all its grams, so a needle of which one is nowhere is on no page, and the rarest leads to the pages to look at.
    Grams meet by an equi-join, so the work grows with text and needles, not with their product; a page's text is moved once for all needles that may be on it.
    """
    asked = kept(_grams(needles.withColumns({"key": F.xxhash64("needle"), "text": F.col("needle")}).select("doc", "key", "text"), "text"), "needle-grams")
    wanted = asked.select("doc", "gram").distinct()
    hits = kept(_grams(index.select("doc", "page_no", "norm"), "norm").join(sized(wanted), ["doc", "gram"], "left_semi"), "page-grams")
    counts = hits.groupBy("doc", "gram").agg(F.count("*").alias("n_pages"))
    known = asked.join(counts, ["doc", "gram"], "left").groupBy("doc", "key").agg(F.min(F.struct("n_pages", "gram"))["gram"].alias("gram"), F.count_if(F.col("n_pages").isNull()).alias("absent"))
    tried = known.filter("absent = 0").join(hits, ["doc", "gram"]).select("doc", "key", "page_no")
    by_page = tried.join(needles.withColumn("key", F.xxhash64("needle")), ["doc", "key"]).groupBy("doc", "page_no").agg(F.collect_list("needle").alias("needles"))
    held = index.join(by_page, ["doc", "page_no"]).select("doc", "page_no", F.explode(F.filter("needles", lambda n: F.contains("norm", n))).alias("needle"))
    return held.groupBy("doc", "needle").agg(F.min("page_no").alias("page_no"))


def verify_evidence(index: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence (doc, quote_id, quote, declared, section_pages) with the page that holds the quote and what was done.

    The declared page goes first, then the section's, then any. The pages that a quote names are met by their number; only what none of these
    holds is looked for in its whole document, by first_pages(). So the work grows with quotes and with text, not with their product.
    """
    index = kept_once(index, "index")
    needles = evidence.select("doc", "quote_id", "declared", "section_pages", T.match_form(F.substring("quote", 1, T.MAX_QUOTE)).alias("needle")).filter(F.length("needle") >= T.MIN_QUOTE)
    needles = kept(needles, "quote-needles")
    own = F.array_distinct(F.filter(F.concat(F.array("declared"), F.coalesce("section_pages", F.array().cast("array<int>"))), lambda p: p.isNotNull()))
    named = needles.select("doc", "quote_id", "needle", F.posexplode(own).alias("p", "page_no"))
    here = named.join(index, ["doc", "page_no"]).filter(F.contains("norm", "needle")).groupBy("doc", "quote_id").agg(F.min(F.struct("p", "page_no"))["page_no"].alias("page"))
    best = here = kept(here, "named-pages")
    rest = kept(needles.join(here, ["doc", "quote_id"], "left_anti").select("doc", "quote_id", "needle"), "unnamed-quotes")
    if rest.limit(1).count():
        anywhere = rest.join(first_pages(index, rest.select("doc", "needle").distinct()), ["doc", "needle"])
        best = here.unionByName(anywhere.select("doc", "quote_id", F.col("page_no").alias("page")))
    action = F.when(F.col("page").isNull(), F.lit("removed")).when(F.col("declared").isNull(), F.lit("added page")).when(F.col("page") != F.col("declared"), F.lit("corrected page")).otherwise(F.lit("kept"))
    return evidence.join(best, ["doc", "quote_id"], "left").withColumn("action", action)


def number_postings(index: DataFrame) -> DataFrame:
    """doc, key, run, page_no: the runs of digits, points and commas on each page that begin with a digit, and their first digits."""
    runs = F.array_distinct(F.regexp_extract_all("norm", F.lit("(?<![0-9.,])([0-9][0-9.,]*)"), 1))
    return index.select("doc", "page_no", F.explode(runs).alias("run")).withColumn("key", F.regexp_extract("run", "^[0-9]+", 0))


def number_pages(index: DataFrame, numbers: DataFrame) -> DataFrame:
    """doc, number, page_no: the pages on which numbers (doc, number; different ones) are whole tokens.

    Such a token begins a run, so it meets the runs with its first digits, and what is left of the run must not go on with a digit.
    """
    asked = numbers.withColumn("key", F.regexp_extract("number", "^[0-9]+", 0))
    left = F.substring("run", F.length("number") + 1, F.lit(2))
    whole = F.startswith("run", "number") & ((left == "") | left.rlike("^[.,](?![0-9])"))
    return number_postings(index).join(asked, ["doc", "key"]).filter(whole).select("doc", "number", "page_no").distinct()


def pages_with_numbers(index: DataFrame, sought: DataFrame) -> DataFrame:
    """doc, needle, page_no: the pages with every number of sought (doc, needle, numbers). The rarest number of a needle gives the pages to look at."""
    pairs = sought.select("doc", "needle", F.array_distinct("numbers").alias("numbers")).select("doc", "needle", F.size("numbers").alias("n"), F.explode("numbers").alias("number"))
    places = kept(number_pages(index, pairs.select("doc", "number").distinct()), "number-pages")
    one = pairs.filter("n = 1").join(places, ["doc", "number"]).select("doc", "needle", "page_no")
    counts = places.groupBy("doc", "number").agg(F.count("*").alias("n_pages"))
    ranked = pairs.filter("n > 1").join(counts, ["doc", "number"]).groupBy("doc", "needle", "n").agg(F.sort_array(F.collect_list(F.struct("n_pages", "number"))).alias("by"))
    full = ranked.filter(F.size("by") == F.col("n"))  # a number that is on no page has no count
    tried = full.select("doc", "needle", "n", F.col("by")[0]["number"].alias("number"), F.transform(F.slice("by", 2, F.size("by")), lambda x: x["number"]).alias("others"))
    tried = tried.join(places, ["doc", "number"]).select("doc", "needle", "n", "page_no", F.explode("others").alias("number"))
    many = tried.join(places, ["doc", "number", "page_no"]).groupBy("doc", "needle", "n", "page_no").agg(F.count("*").alias("met")).filter(F.col("met") == F.col("n") - 1)
    return one.unionByName(many.select("doc", "needle", "page_no"))


#: Pages that a metric keeps at most.
METRIC_PAGES = 4


def first_runs(index: DataFrame) -> DataFrame:
    """doc, page_no, norm: each page's runs of digits, points and commas that it is among the METRIC_PAGES first to hold.

    These suffice for the first pages with a number: a page among them is also among the first of the run that holds it.
    """
    rows = index.select("doc", "page_no", F.explode(F.array_distinct(F.regexp_extract_all("norm", F.lit("([0-9.,]+)"), 1))).alias("run"))
    least = rows.groupBy("doc", "run").agg(F.slice(F.array_sort(F.collect_set("page_no")), 1, METRIC_PAGES).alias("first"))
    return least.select("doc", "run", F.explode("first").alias("page_no")).groupBy("doc", "page_no").agg(F.array_join(F.collect_list("run"), " ").alias("norm"))


def verify_metrics(index: DataFrame, metrics: DataFrame) -> DataFrame:
    """metrics (doc, metric_id, value, cited) with pages and verified.

    A page fits if it holds the value or each of its numbers as a whole token. Cited pages are tried first,
    then all; four pages are kept at most, and an unverified metric keeps what it cited. A value that is a number is looked for in the pages'
    numbers alone, the numbers of others in an inverted index, and only values with words in the whole text.
    """
    index, metrics = kept_once(index, "index"), kept(metrics, "metrics")  # both are read several times
    needle = T.match_form(F.col("value"))
    wanted = metrics.withColumns({"needle": needle, "numbers": T.number_tokens(needle)}).filter("needle != ''")
    sought = kept(wanted.select("doc", "needle", "numbers").distinct(), "values")  # equal values of a document are looked for once
    alone = (F.size("numbers") == 1) & (F.get("numbers", 0) == F.col("needle"))
    places = needle_pages(first_runs(index), sought.filter(alone).select("doc", "needle"))
    said = sought.filter(~alone)
    if said.limit(1).count():
        places = places.unionByName(needle_pages(index, said.select("doc", "needle"))).unionByName(pages_with_numbers(index, said.filter(F.size("numbers") > 0)))
    places = places.groupBy("doc", "needle").agg(F.slice(F.array_sort(F.collect_set("page_no")), 1, METRIC_PAGES).alias("any"))
    # cited pages are looked at by their number, so no metric carries all pages that hold its value
    named = wanted.filter(F.size("cited") > 0).select("doc", "metric_id", "needle", "numbers", F.explode(F.array_distinct("cited")).alias("page_no")).join(index, ["doc", "page_no"])
    fits = F.contains("norm", "needle") | ((F.size("numbers") > 0) & F.forall("numbers", lambda n: T.has_number(F.col("norm"), n)))
    own = named.filter(fits).groupBy("doc", "metric_id").agg(F.slice(F.array_sort(F.collect_set("page_no")), 1, METRIC_PAGES).alias("own"))
    near = F.when(F.size("cited") == 0, F.col("any")).when(F.size("cited") > 0, F.coalesce("own", F.array().cast("array<int>")))
    found = wanted.join(places, ["doc", "needle"]).join(own, ["doc", "metric_id"], "left").select("doc", "metric_id", near.alias("near"), "any")
    pages = F.when(F.size("near") > 0, F.col("near")).when(F.size("any") > 0, F.col("any")).otherwise(F.col("cited"))
    joined = metrics.join(found, ["doc", "metric_id"], "left")
    return joined.select(*metrics.columns, F.slice(F.coalesce(pages, F.col("cited")), 1, METRIC_PAGES).alias("pages"), (F.coalesce(F.size("any"), F.lit(0)) > 0).alias("verified"), ((F.size("near") == 0) & (F.size("any") > 0)).alias("relocated"))


def drop_fragments(quotes: DataFrame) -> DataFrame:
    """quotes (doc, page_no, ord, quote) without repeats and without those that are part of a longer one on the same page."""
    first = quotes.groupBy("doc", "page_no", "quote").agg(F.min("ord").alias("ord"))
    norm = first.withColumn("norm", T.match_form(F.col("quote")))
    other = norm.select("doc", "page_no", F.col("quote").alias("o"), F.col("norm").alias("onorm"))
    return norm.join(other, (norm["doc"] == other["doc"]) & (norm["page_no"] == other["page_no"]) & (F.col("quote") != F.col("o")) & F.contains("onorm", "norm"), "left_anti").select("doc", "page_no", "ord", "quote")


def source_refs(sections: DataFrame, metrics: DataFrame) -> DataFrame:
    """doc, page_no, used_in, quotes from sections (doc, ord, heading, pages, evidence) and verified metrics (doc, pages)."""
    used = sections.select("doc", F.explode("pages").alias("page_no"), "ord", "heading")
    tagged = metrics.filter("verified").select("doc", F.explode("pages").alias("page_no")).distinct().select("doc", "page_no", F.lit(1 << 30).alias("ord"), F.lit("Important data / metrics").alias("heading"))
    names = used.unionByName(tagged).groupBy("doc", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "heading"))), lambda x: x["heading"]).alias("used_in"))
    quoted = sections.select("doc", "ord", F.posexplode("evidence").alias("pos", "e")).select("doc", F.col("e.page").alias("page_no"), (F.col("ord") * 1000 + F.col("pos")).alias("ord"), F.col("e.quote").alias("quote"))
    quotes = drop_fragments(quoted).groupBy("doc", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "quote"))), lambda x: x["quote"]).alias("quotes"))
    return names.join(quotes, ["doc", "page_no"], "full").select("doc", "page_no", F.coalesce("used_in", F.array().cast("array<string>")).alias("used_in"), F.coalesce("quotes", F.array().cast("array<string>")).alias("quotes"))


def claimed_pages(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, claim_id, pages, dropped of claims (doc, claim_id, raw VARIANT): the pages that a raw value names and that are among pages (doc, page_no; different ones), and how many of its parts are not.

    Items come out of the variant as rows, so a claim of any length is dealt with by rows, and meet the pages by a join.
    """
    spark = claims.sparkSession
    rows = claims.withColumn("list", F.when(F.schema_of_variant("raw").startswith("ARRAY"), F.col("raw")))
    many = rows.filter("list is not null").lateralJoin(spark.tvf.variant_explode_outer(F.col("list").outer())).select("doc", "claim_id", F.col("value").alias("item"))
    one = rows.filter("list is null").select("doc", "claim_id", F.when(F.schema_of_variant("raw") != "VOID", F.col("raw")).alias("item"))
    # one table of all numbers that are named, with a row for what names none, so each claim meets the pages once and is gathered once
    numbers = many.unionByName(one).select("doc", "claim_id", F.when(F.col("item").isNotNull(), F.coalesce(T.page_span(F.col("item")), F.array(F.lit(None).cast("int")))).alias("numbers"))
    named = numbers.select("doc", "claim_id", F.explode_outer("numbers").alias("page_no"), F.col("numbers").isNotNull().alias("said"))
    met = named.join(pages.select("doc", "page_no", F.lit(1).alias("known")), ["doc", "page_no"], "left")
    found = F.array_sort(F.collect_set(F.when(F.col("known") == 1, F.col("page_no"))))
    return met.groupBy("doc", "claim_id").agg(found.alias("pages"), F.count_if(F.col("said") & F.col("known").isNull()).alias("dropped"))
