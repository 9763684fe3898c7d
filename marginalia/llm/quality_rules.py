"""Quality rules by cross-document line frequency; DataFrame functions alone.

Base figures come from each whole text by array functions inside its own row, so
no word is ever shuffled. Then every non-blank line is normalised (ASCII letters
lower-cased, runs of digits to `0`, white space runs to one space, trimmed) and hashed with its host (the
document's source); for each host and line the distinct documents are counted, and lines of more
than `LIMIT` documents of the host are removed, on a host of any size. A document that keeps fewer than
`LEAST_KEPT` of its words' characters is depleted and rejected.

Exact copies must not make each other's lines look like boilerplate, so documents
are told apart by a hash of the whole text; near copies count each.

Counts are pre-aggregated before each shuffle, first by (line, text), then
by line, so a host or a line with a third of all rows is spread. Frequent lines go back to the texts that have them by
the line's hash, and to the rows by (host, text): broadcast up to `BROADCAST_ENTRIES`, else by a join whose two sides are
tables, so that Spark splits the shuffle of a key with many rows.

Defined results: a null text has no words, so it fails the base rules; a null
source is a host of its own; repeated rows get equal results; an empty table
gives an empty table; other columns are ignored; texts of any length stay
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, kept_table, table

#: White space between words, and the characters that count as symbols.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20
#: A line is removed on a host if more of its distinct documents have it.
LIMIT = 20
#: A document that keeps less of its words' characters is rejected.
LEAST_KEPT = 0.3
#: Entries of a small table (its rows and what their arrays hold) that are broadcast; a larger one is joined by a shuffle.
BROADCAST_ENTRIES = 500_000


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once: a lambda's variable is never inlined."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " ", -1), "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = bound(hashes, lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, WINDOW)))))

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = bound(
            ordered,
            lambda o: F.filter(o, lambda x, k: (F.get(o, k - 1)["h"] == x["h"]) | (F.get(o, k + 1)["h"] == x["h"])),
        )
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        steps = bound(places, lambda p: F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return bound(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def normalised(line: Column) -> Column:
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(F.regexp_replace(lower, "[0-9]+", "0"), r"[ \t\x0B\f\r]+", " "))


def host_and_mark() -> dict[str, Column]:
    """Hashes of a row's host and of its whole text."""
    return {"_host": F.xxhash64(F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "_mark": F.xxhash64(F.coalesce("text", F.lit("")))}


def split_texts(docs: DataFrame) -> DataFrame:
    """All columns of docs, and _host, _mark, _text, _words and _lines (those with a word)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    return docs.withColumns(host_and_mark() | {"_text": text, "_words": words_of(text), "_lines": lines})


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.col("_host"), normalised(line))


def hashed_lines() -> Column:
    return F.transform("_lines", lambda x: F.struct(line_hash(x).alias("line"), F.length(F.translate(x, SPACE, "")).alias("chars")))


def figures() -> dict[str, Column]:
    """The base figures of split_texts()."""
    return {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_text", SPACE, "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
    }


def sized(df: DataFrame, array: str | None = None) -> DataFrame:
    """df, to be broadcast if it has few entries."""
    entries = F.count("*") + (F.coalesce(F.sum(F.size(array)), F.lit(0)) if array else F.lit(0))
    return F.broadcast(df) if df.agg(entries).first()[0] <= BROADCAST_ENTRIES else df


def frequent_lines(found: DataFrame, scratch: Scratch) -> DataFrame:
    """_host, _mark, removed: the texts with lines that are too frequent on their host, and these lines' hashes. found: _host, _mark, n_words, lines."""
    lines = found.filter("n_words > 0").select("_host", "_mark", F.explode(F.array_distinct(F.col("lines")["line"])).alias("line"))
    counts = lines.select("_mark", "line").distinct().groupBy("line").agg(F.count("*").alias("n"))
    frequent = scratch.keep(counts.filter(F.col("n") > LIMIT).select("line"), "frequent")
    return scratch.keep(lines.join(sized(frequent), "line").groupBy("_host", "_mark").agg(F.collect_set("line").alias("removed")), "texts")


def removed_chars(lines: Column) -> Column:
    gone = F.filter(lines, lambda x: F.array_contains("removed", x["line"]))
    return F.when(F.col("removed").isNull(), F.lit(0)).otherwise(F.aggregate(gone, F.lit(0), lambda a, x: a + x["chars"])).cast("long")


def text_left() -> Column:
    """The text without the lines whose hashes are in removed; blank lines stay."""
    return F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("removed", line_hash(x))), "\n")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def keeps_enough() -> Column:
    return F.col("word_chars") - F.col("removed_chars") >= LEAST_KEPT * F.col("word_chars")


def judged(docs: DataFrame, *columns: str) -> DataFrame:
    """The given columns, _host, _mark, the figures, base_failed, kept, removed_chars and removed for every row of docs (text, source)."""
    scratch = Scratch(docs.sparkSession, "lines")
    split = split_texts(docs.select(*columns, "text", "source"))
    found = scratch.keep(split.select(*columns, "_host", "_mark", *(c.alias(n) for n, c in figures().items()), hashed_lines().alias("lines")), "figures")
    left = found.join(sized(frequent_lines(found, scratch), "removed"), ["_host", "_mark"], "left")
    left = left.withColumn("removed_chars", removed_chars(F.col("lines"))).withColumn("base_failed", base_failed())
    return left.withColumn("kept", ~F.col("base_failed") & keeps_enough()).drop("lines")


def judge(docs: DataFrame) -> DataFrame:
    """Figures and verdict for every row of docs (doc_id, text, source)."""
    rows = judged(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return rows.select("doc_id", *figures(), "base_failed", "kept", "removed_chars")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns; text is without its host's frequent lines, and
    n_chars, where docs has it, is the length of a text that lost any.

    Figures and lines come from one pass over the texts; the second only looks up what becomes of a text, by its hash.
    """
    verdicts = judged(docs.select("text", "source")).filter(~F.col("kept") | F.col("removed").isNotNull())
    decided = kept_table(verdicts.groupBy("_host", "_mark").agg(F.first("kept").alias("_kept"), F.first("removed").alias("removed")), "decided")
    own = F.struct(*docs.columns).alias("_row")
    rows = docs.select(own, "text", "source").withColumns(host_and_mark()).join(sized(decided, "removed"), ["_host", "_mark"], "left").filter(F.coalesce("_kept", F.lit(True)))
    left = rows.withColumn("_left", F.when(F.col("removed").isNotNull(), text_left()))
    changed = F.col("_left").isNotNull() & (F.length("_left") != F.length("text"))
    new = {"text": F.coalesce("_left", F.col("_row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return left.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


#: The same rows by strings instead of hashes, over the view `documents`: lines of more than LIMIT different texts of a host.
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents
), sp AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS s),
t AS (
  SELECT r, doc_id, host, text, translate(text, s, '') AS solid,
    list_filter(string_split(translate(text, s, '      '), ' '), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: length(translate(x, s, '')) > 0) AS lines
  FROM d, sp
), win AS (
  SELECT r, i, array_to_string(words[i:i+4], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM t WHERE len(words) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r
), texts AS (
  SELECT text, row_number() OVER () AS text_no FROM (SELECT DISTINCT text FROM t)
), ln AS (
  SELECT r, host, text_no, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[ \t\x0B\f\r]+', ' ', 'g')) AS line, length(translate(line, s, '')) AS chars
  FROM (SELECT r, host, text_no, unnest(lines) AS line FROM t JOIN texts USING (text)), sp
), frequent AS (
  SELECT host, line FROM ln GROUP BY host, line HAVING count(DISTINCT text_no) > {LIMIT}
), gone AS (
  SELECT r, sum(chars) AS chars FROM ln JOIN frequent USING (host, line) GROUP BY r
), f AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(solid) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone.chars, 0) AS BIGINT) AS removed_chars
  FROM t LEFT JOIN covered USING (r) LEFT JOIN gone USING (r)
), b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars - removed_chars >= {LEAST_KEPT} * word_chars AS kept, removed_chars
FROM b
"""
