"""URL filter: rules first, then naive Bayes over segmented host and path words.

Tokens are runs of letters or of digits, lower-cased. A token of letters is split by
unigram Viterbi: the split with the highest product of word probabilities,
where a word outside the lexicon costs as much as a tenth of a word seen once,
and tenfold less for every letter. Multinomial naive Bayes with add-one smoothing
then compares `allow` and `block` over the words of host and path, learnt from
every row that a rule decides.

The lexicon starts from the paths and the hyphenated host labels of all rows (a whole label may be
words run together, so it is no evidence that it is a word itself), and keeps words with at least
`MIN_SHARE` of these tokens. Words that other, no rarer words of `LEAST_PART` letters and more make up are taken out, and what is left is counted
anew over the splits of all hosts and paths. It has 1 / MIN_SHARE entries at most at any size
of the input. The weights of words with at least `MIN_SHARE` of what is counted go to the workers too; rarer words are scored by a join
with the table of their counts, so every word that a decided row has is evidence.

Defined results: a null URL, or one without `://`, has an empty host and path
and the verdict `allow`; so has a URL without any token and a tie. If no rule
decides any row, every other row is a tie. Repeated rows are judged alike;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import kept_table, table

#: (verdict, rule): a host, and a path that starts with what follows it.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The least share of all that is counted for a word of the lexicon, and for a weight that workers hold.
MIN_SHARE = 1e-5
#: Letters of a word that may make up another.
LEAST_PART = 3
#: Splits that a worker remembers before it starts afresh, of tokens of so many letters at most.
SPLITS_KEPT, KEPT_LETTERS = 200_000, 100
TOKEN = re.compile(r"[^\W\d_]+|\d+")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), ALPHABET, ALPHABET.lower())
    return pages.withColumns({"host": host, "path": F.regexp_extract(url, pattern, 2)})


def rule_column(rules=RULES) -> Column:
    """The longest rule that fits host and path, else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda x: len(x[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Lexicon:
    """Unigram word costs and the split of least cost."""

    def __init__(self, counts: dict[str, int], total: int):
        self.total = max(1, total)
        self.cost = {w: -math.log(max(c, 0.5) / self.total) for w, c in counts.items()}
        self.lengths = sorted({len(w) for w in counts}, reverse=True)
        self.unknown, self.letter = math.log(10 * self.total), math.log(10)
        self._cached: dict[str, tuple[str, ...]] = {}

    def word_cost(self, word: str) -> float:
        return self.cost.get(word, self.unknown + len(word) * self.letter)

    def split(self, token: str) -> tuple[str, ...]:
        if token in self._cached:
            return self._cached[token]
        found = self.parts(token)
        if len(token) <= KEPT_LETTERS:
            if len(self._cached) >= SPLITS_KEPT:
                self._cached.clear()
            self._cached[token] = found
        return found

    def parts(self, token: str, without: str = "") -> tuple[str, ...]:
        """Viterbi over the letters: at each one the best split so far, and the best whose last word is unknown and still open. Ties take the longer last word."""
        if token.isdigit():
            return ("0",)
        best, back = [0.0], [0]
        run, begun = math.inf, 0  # cost and start of the open unknown word
        for end in range(1, len(token) + 1):
            start = best[end - 1] + self.unknown
            if start < run:
                run, begun = start, end - 1
            run += self.letter
            cost, at = run, begun
            for n in self.lengths:
                if n <= end:
                    word = token[end - n : end]
                    if word in self.cost and word != without and best[end - n] + self.cost[word] <= cost:
                        cost, at = min((cost, at), (best[end - n] + self.cost[word], end - n))
            best.append(cost)
            back.append(at)
        words, end = [], len(token)
        while end:
            words.append(token[back[end] : end])
            end = back[end]
        return tuple(reversed(words))

    def words(self, host: str, path: str) -> list[str]:
        """The words of host and path, marked by where they stand; `0` stands for numbers."""
        return [f"{place}:{w}" for place, text in (("h", host), ("p", path)) for t in tokens(text) for w in self.split(t)]

    def without_compounds(self, counts: dict[str, int]) -> dict[str, int]:
        """counts without the words that others make up."""
        made_up = lambda w, parts: len(parts) > 1 and all(len(x) >= LEAST_PART and counts.get(x, 0) >= counts[w] for x in parts)
        return {w: n for w, n in counts.items() if len(w) < 2 * LEAST_PART or not made_up(w, self.parts(w, w))}


def hyphenated(host: str) -> str:
    """The labels of host that have a hyphen."""
    return " ".join(x for x in host.split(".") if "-" in x)


def count_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = Counter(t for host, path in zip(pdf["host"], pdf["path"]) for t in tokens(f"{host} {path}") if not t.isdigit())
        words = Counter(t for host, path in zip(pdf["host"], pdf["path"]) for t in tokens(f"{hyphenated(host)} {path}") if not t.isdigit())
        if found:
            yield pd.DataFrame({"word": list(found), "n": list(found.values()), "n_word": [words[t] for t in found]})


def fit_lexicon(pages: DataFrame) -> Lexicon:
    """From all rows of pages (host, path)."""
    counts = kept_table(pages.select("host", "path").mapInPandas(count_tokens, "word string, n long, n_word long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_word").alias("n_word")), "url-tokens")
    total = counts.agg(F.sum("n_word")).first()[0] or 0
    alone = {r["word"]: r["n_word"] for r in counts.filter((F.col("n_word") > 0) & (F.col("n_word") >= F.lit(total * MIN_SHARE))).collect()}
    floor = round(1 / MIN_SHARE)  # else short tables make unknown words cheap
    left = Lexicon(alone, max(total, floor)).without_compounds(alone)
    first = pages.sparkSession.sparkContext.broadcast(Lexicon(left, max(total, floor)))

    def split_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: Counter = Counter()
            for token, n in zip(pdf["word"], pdf["n"]):
                for w in first.value.parts(token):
                    found[w if w in first.value.cost else ""] += n
            yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    again = {r["word"]: r["n"] for r in counts.select("word", "n").mapInPandas(split_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # the lexicon's words
    return Lexicon({w: again.get(w, 0) for w in left}, max(sum(again.values()), floor))


class NaiveBayes:
    """Log odds of `block` for words: the frequent ones' weights, and what the others' counts are weighed by."""

    def __init__(self, rows: dict[str, int], totals: dict[str, int], vocabulary: int, frequent: dict[str, tuple[int, int]], rare: bool):
        self.prior = math.log((rows.get("block", 0) + 1) / (rows.get("allow", 0) + 1))
        self.block, self.allow = totals.get("block", 0) + vocabulary + 1, totals.get("allow", 0) + vocabulary + 1
        self.weight = {w: math.log((b + 1) / self.block) - math.log((a + 1) / self.allow) for w, (b, a) in frequent.items()}
        self.rare = rare

    def score(self, words: list[str]) -> float:
        """Log odds of `block` by the frequent words; 0 for no words."""
        return self.prior + sum(self.weight.get(w, 0.0) for w in words) if words else 0.0

    def column(self, block: Column, allow: Column) -> Column:
        """The weight of a rare word by its counts."""
        return F.log((block + 1) / F.lit(float(self.block))) - F.log((allow + 1) / F.lit(float(self.allow)))


def fit_bayes(pages: DataFrame, lexicon) -> tuple[NaiveBayes, DataFrame]:
    """From all rows of pages (host, path, decided) with a decided verdict; lexicon is a broadcast Lexicon. With it the table of all words' counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: Counter = Counter()
            for host, path, verdict in zip(pdf["host"], pdf["path"], pdf["decided"]):
                found[verdict, ""] += 1
                found.update((verdict, w) for w in lexicon.value.words(host, path))
            yield pd.DataFrame([(v, w, n) for (v, w), n in found.items()], columns=["verdict", "word", "n"])

    counted = pages.filter("decided is not null").select("host", "path", "decided").mapInPandas(count, "verdict string, word string, n long")
    of = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, F.col("n")).otherwise(0)).alias(verdict)
    words = kept_table(counted.groupBy("word").agg(of("block"), of("allow")), "url-words")
    rows = {k: v or 0 for k, v in (words.filter("word = ''").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).first().asDict()).items()}
    words = words.filter("word != ''")
    sums = words.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("n")).first()
    totals = {"block": sums["block"] or 0, "allow": sums["allow"] or 0}
    frequent = {r["word"]: (r["block"], r["allow"]) for r in words.filter(F.col("block") + F.col("allow") >= F.lit(sum(totals.values()) * MIN_SHARE)).collect()}
    return NaiveBayes(rows, totals, sums["n"], frequent, len(frequent) < sums["n"]), words


def scored(ruled: DataFrame, lexicon, bayes, words: DataFrame) -> DataFrame:
    """ruled with block_score."""

    @F.pandas_udf(StructType([StructField("score", DoubleType()), StructField("rare", ArrayType(StringType()))]))
    def partial(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        model, found = bayes.value, []
        for h, p in zip(host, path):
            said = lexicon.value.words(h, p)
            found.append((model.score(said), [w for w in said if w not in model.weight] if model.rare else []))
        return pd.DataFrame(found, columns=["score", "rare"])

    rows = ruled.withColumn("x", partial("host", "path"))
    if not bayes.value.rare:
        return rows.withColumn("block_score", F.col("x.score")).drop("x")
    rows = kept_table(rows, "url-scores")
    said = rows.filter(F.size("x.rare") > 0).select("host", "path", "x.rare").distinct().select("host", "path", F.explode("rare").alias("word"))
    weights = words.select("word", bayes.value.column(F.col("block"), F.col("allow")).alias("weight"))
    more = kept_table(said.join(weights, "word").groupBy("host", "path").agg(F.sum("weight").alias("more")), "url-rare")
    return rows.join(more, ["host", "path"], "left").withColumn("block_score", F.col("x.score") + F.coalesce("more", F.lit(0.0))).drop("x", "more")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every row of pages (page_id, url)."""
    spark = pages.sparkSession
    ruled = with_host_and_path(pages.select("page_id", "url")).withColumn("rule", rule_column(rules))
    verdicts = F.lit(None).cast("string")
    for verdict, rule in rules:
        verdicts = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdicts)
    ruled = ruled.withColumn("decided", verdicts)
    lexicon = spark.sparkContext.broadcast(fit_lexicon(ruled))
    model, words = fit_bayes(ruled, lexicon)
    found = scored(ruled, lexicon, spark.sparkContext.broadcast(model), words)
    method = F.when(F.col("block_score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "block_score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
