"""Language ID, quality rules, HTML extraction and URL filter on small fixtures."""

import html as H
import itertools
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from marginalia.llm import html_extract, language_id, quality_rules, url_filter
from marginalia.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ language ID
def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    lengths, n = np.asarray([4, 3, 1]), 3
    emission, transition = rng.normal(size=(3, 4, n)), rng.normal(size=(n, n))
    gamma, pairs = language_id.forward_backward(emission, lengths, transition)
    want_pairs = np.zeros((n, n))
    for r, size in enumerate(lengths):
        weights = {}
        for path in np.ndindex(*[n] * size):
            weights[path] = np.exp(sum(emission[r, i, y] for i, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
        z = sum(weights.values())
        want = np.zeros((size, n))
        for path, w in weights.items():
            for i, y in enumerate(path):
                want[i, y] += w / z
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += w / z
        assert np.allclose(gamma[r, :size], want)
    assert np.allclose(pairs, want_pairs)


def test_segments_make_one_chain(monkeypatch):
    """Marginals of a text in segments are those of the whole chain."""
    rng = np.random.default_rng(4)
    model = language_id.Model(["a", "b", "c"], rng.normal(size=(1 << language_id.HASH_BITS, 3)) * 0.2, 3 * np.eye(3) + rng.normal(size=(3, 3)), frozenset())
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 50, n)).translate({48 + k: 97 + k for k in range(10)}).encode() for n in (0, 1, 6, 7, 40, 97)]
    whole = model.marginals(texts)
    monkeypatch.setattr(language_id, "SEGMENT", 7)
    parts = model.marginals(texts)
    assert all(np.allclose(a, b) for a, b in zip(whole, parts)) and len(parts[5]) == 97
    monkeypatch.setattr(model, "_edges", lambda pieces: (np.ones((len(pieces), 3)), np.ones((len(pieces), 3))))
    assert not np.allclose(model.marginals(texts)[5], whole[5])


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = language_id.op9_language_id(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(held) > 100 and sum(held) / len(held) > 0.98


def test_language_of_odd_rows_and_switched_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_on(docs)
    by = {r["lang"]: r["text"] for r in docs.filter("length(text) > 800").collect()}
    words = by["en"].split()[:60] + by["de"].split()[:60]
    labels = model.marginals([" ".join(words).encode()])[0].argmax(1)
    truth = [model.labels.index("en")] * 60 + [model.labels.index("de")] * 60
    assert np.mean(labels == truth) > 0.9
    rows = [(1, None), (2, ""), (3, "12 3!"), (4, by["fr"] * 30), (4, by["fr"] * 30), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "1 as score")
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.label_documents(frame, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "fr")} <= got
    assert language_id.label_documents(frame.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.label_documents(frame.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}


def test_text_without_spaces_is_labelled_whole(spark, sf_dir):
    model = language_id.fit_on(table(spark, sf_dir, "documents"))
    by = {r["lang"]: "".join(re.findall(r"[^\W\d_]+", r["text"]))[:640] for r in table(spark, sf_dir, "documents").filter("length(text) > 1500").collect()}
    text = by["en"][:40] + "1.2" + by["de"]
    assert "".join(language_id.words_of(text)) == text and b"".join(language_id.byte_words_of(text.encode())).decode() == text
    assert model.predict([text.encode()])[0][0] == "de"
    assert len(model.marginals([text.encode()])[0]) == 17 and language_id.words_of("1" * 99) == ["1" * 99]


# ------------------------------------------------------------------ quality rules
def base_figures(text):
    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    full = [x for x in lines if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(covered), failed)


def quality_rows():
    boiler = "Subscribe to our newsletter 2024 and never miss a thing again my friend"
    rows = [(i, f"{boiler.replace('2024', str(i))}\nunique{i}word" if i % 2 else f"{boiler}\n" + " ".join(f"own{i}w{k}longer" for k in range(60)), "host") for i in range(30)]
    copied = " ".join(f"copied{k}" for k in range(40))
    rows += [(100 + i, copied, "host") for i in range(40)] + [(200, None, None), (201, "", "host"), (202, " \n\t", None), (203, "a b c d e " * 30, "host"), (204, "# *$ x\x0by\u00a0z é\n\nsame\nsame\r", "other"), (204, "# *$ x\x0by\u00a0z é\n\nsame\nsame\r", "other"), (None, "w " * 9, None), (205, "long " * 20000, "host")]
    return rows


def test_quality_rules(spark):
    rows = quality_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'h' as host", "1 as lines", "2 as mark", "3 as n_words", "4 as removed")
    result = quality_rules.judge(frame).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in result), key=str) == sorted(((d, *base_figures(t)) for d, t, _ in rows), key=str)
    kept = {r["doc_id"] for r in result if r["kept"]}
    assert kept >= set(range(100, 140)) | set(range(0, 30, 2)) and not kept & set(range(1, 30, 2))
    assert sorted((r["doc_id"] for r in quality_rules.keep(frame).collect()), key=str) == sorted((r["doc_id"] for r in result if r["kept"]), key=str)
    assert quality_rules.judge(frame.limit(0)).count() == 0
    con = duckdb.connect()
    documents = frame.select("doc_id", "text", "source").toArrow()  # noqa: F841  read by the SQL
    want = con.execute(quality_rules.ORACLE).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in result)


def test_documents_with_a_longest_word_in_common_are_counted(spark):
    footer = "see https://example.org/terms-and-conditions-of-this-site for more"
    texts = [f"{footer}\n" + " ".join("own" + chr(97 + i % 26) * (1 + i // 26) + chr(97 + k) for k in range(20)) for i in range(30)]
    rows = [(i, t, "host") for i, t in enumerate(texts)] + [(100 + i, texts[0], "host") for i in range(30)] + [(200 + i, "copied words stand here in a row of ten again\n" + "tail", "host") for i in range(30)]
    got = {r["doc_id"]: r["removed_chars"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {got[i] for i in range(30)} == {len(footer.replace(" ", ""))} and {got[200 + i] for i in range(30)} == {0}


def test_kept_texts_lose_their_frequent_lines(spark):
    def own(i):
        return " ".join("own" + chr(97 + i % 26) * (1 + i // 26) + chr(97 + k) for k in range(20))

    rows = [(i, f"All rights reserved {i}\n\n{own(i)}\n  all RIGHTS reserved 7\nend {own(i)[:9]}", "host", 5) for i in range(30)] + [(90, f"{own(40)}\n\nAll rights reserved 1\n", "other", 5), (91, own(41), None, 5)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in quality_rules.keep(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")).collect()}
    want = {i: f"\n{own(i)}\nend {own(i)[:9]}" for i in range(30)}
    assert got == {i: (t, len(t)) for i, t in want.items()} | {i: (t, n) for i, t, _, n in rows[30:]}


# ------------------------------------------------------------------ HTML
PAGE = """<html><head><title>T</title><script>x="<p>no</p>"</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site work.</p></div><article><h1>Big &amp; new</h1><p>First  paragraph of the story, which is long enough&nbsp;to read.
<p>Second <b>paragraph</b> of the story, with more words, and a stop.</article><section id="comments"><div class="comment"><p>I liked this story.</p></div></section>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other</a></li></ul></aside><form><p>Sign up</p><input name=q></form><footer>&copy; 2020 Example</footer></body>"""


def test_the_most_frequent_of_many_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 5)
    rows = [(1000 * k + i, f"text {i}", f"l{k}") for k in range(8) for i in range(40 - 4 * k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {lang for _, lang in language_id.training_rows(docs)} == {f"l{k}" for k in range(5)}
    assert language_id.training_rows(docs) == language_id.training_rows(docs.repartition(3))


def test_main_text():
    got = html_extract.extract_pages([PAGE, None, "", "<p>", "plain words only, no markup at all."], html_extract.fitted_model())
    assert got[0] == "Big & new\n\nFirst paragraph of the story, which is long enough to read.\n\nSecond paragraph of the story, with more words, and a stop."
    assert got[1:4] == ["", "", ""]


def test_whole_pages(spark, sf_dir):
    want = {}
    for r in table(spark, sf_dir, "pages").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = [" ".join(H.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", article.replace("<br>", " "))]
        want[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    rows = html_extract.op3_html_extract(spark, sf_dir).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_odd_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x"), (2, "u", "<div>" * 3000 + PAGE * 30), (3, "u", "<a href='x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    assert html_extract.extract(frame).count() == 5
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_decoding_is_consistent():
    tree = html_extract.Tree(PAGE)
    rng = np.random.default_rng(1)
    for _ in range(50):
        label = html_extract.decode(tree, rng.normal(size=len(tree.tags)) * 3)
        assert all(label[p] or not keep for keep, p in zip(label[1:], tree.parents[1:]))


def test_decoding_is_the_best_of_all_labellings():
    """Against every labelling of small trees in which nothing below a dropped element is kept."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        tree = html_extract.Tree("".join(f"<{rng.choice(['div', 'p', 'b', 'ul', 'li', 'form'])}>x" if rng.random() < 0.7 else "</div>" for _ in range(8)))
        n, odds = len(tree.tags), rng.normal(size=len(tree.tags)) * 3
        keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        total = lambda label: sum(keep[i] if label[i] else drop[i] for i in range(1, n))
        fits = [x for x in itertools.product([True, False], repeat=n - 1) if all((True, *x)[tree.parents[i]] or not x[i - 1] for i in range(1, n))]
        assert abs(total(html_extract.decode(tree, odds)) - max(total((True, *x)) for x in fits)) < 1e-9


def test_a_page_wrapped_in_a_form(spark, sf_dir):
    pages = [r["html"] for r in table(spark, sf_dir, "pages").collect()]
    wrapped = [re.sub(r"(?s)<body[^>]*>(.*)</body>", lambda m: f"<body><form method=post action=x>{m[1]}</form></body>", p) for p in pages]
    model = html_extract.fitted_model()
    assert html_extract.extract_pages(wrapped, model) == html_extract.extract_pages(pages, model)


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x" + "</section>" * 20_000, "<i>" * 20_000 + "x" + "</b>" * 20_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000, "<p>" + "<i>" * 20_000 + "<hr>" * 20_000])
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    html_extract.Tree(page)
    assert time.process_time() - began < 2


# ------------------------------------------------------------------ URLs
def plain_rule(host, path):
    fits = [r for _, r in url_filter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits, key=len, default=None)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.split(r"[?#]", rest[len(host) :])[0]


@pytest.mark.parametrize("whole", [True, False])
def test_rules(spark, sf_dir, whole):
    odd = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.ORG/en/12?x#y"), (5, "http://example.org"), (6, "x://?q"), (7, "http://É.com/fr/a://b"), (7, "http://É.com/fr/a://b"), (None, "http://notorg/"), (8, "http://" + "casino" * 5000 + ".net/x\ny")]
    pages = table(spark, sf_dir, "pages") if whole else spark.createDataFrame(odd, "page_id long, url string").selectExpr("*", "1 as host", "2 as path", "3 as rule", "4 as decided")
    rows = url_filter.judge(pages).collect()
    verdict = {r: v for v, r in url_filter.RULES}
    given = [(r["page_id"], r["url"]) for r in pages.collect()]
    want = sorted(((i, *plain_parts(u), plain_rule(*plain_parts(u))) for i, u in given), key=str)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in rows), key=str) == want
    assert all(r["verdict"] == verdict[r["rule"]] for r in rows if r["rule"])
    assert all(r["verdict"] == "allow" for r in rows if not r["host"])
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_a_hot_host_is_split(spark):
    rows = [(i, "http://casinowin.net/x") for i in range(100)] + [(100 + i, f"http://site{i}.org/casino/win/page") for i in range(9)] + [(200, "http://best-winter.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    lexicon = url_filter.fit_lexicon(url_filter.with_host_and_path(pages))
    assert lexicon.split("casinowin") == ("casino", "win") and lexicon.split("winter") == ("winter",)
    assert lexicon.words("site1.org", "")[0] == "h:site"


def test_compounds_are_taken_out():
    """A name that paths hold as one word is split where its parts are no rarer."""
    rows = {"best": 40, "casino": 30, "bestcasino": 3, "week": 2, "end": 9, "weekend": 50, "in": 90}
    lexicon = url_filter.Lexicon(rows, 100_000)
    assert lexicon.without_compounds(rows).keys() == rows.keys() - {"bestcasino"}


@pytest.mark.parametrize("share", [1e-5, 0.05, 0.5])
def test_verdicts_match_plain_naive_bayes(spark, monkeypatch, share):
    """Whether words' weights are with the workers or in a table; against counters of all words' splits."""
    rows = [(i, f"http://www.example.{'org' if i % 3 else 'com'}/{'es/casino' if i % 2 else 'de/win'}/page{i % 7}") for i in range(60)]
    rows += [(100, "http://casinowin.net/x"), (101, "http://www.page.net/es"), (101, "http://www.page.net/es"), (102, "http://unseen.net/"), (103, "http://best-casino.net/win/rare"), (104, "http://example.com/de/rare"), (None, "http://de.casino.net"), (105, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    ruled = url_filter.with_host_and_path(frame).withColumn("rule", url_filter.rule_column())
    lexicon = url_filter.fit_lexicon(ruled)  # at one share, so that splits are the same
    monkeypatch.setattr(url_filter, "fit_lexicon", lambda pages: lexicon)
    monkeypatch.setattr(url_filter, "MIN_SHARE", share)
    given, verdict = [(i, *plain_parts(u)) for i, u in rows], {r: v for v, r in url_filter.RULES}
    counts, n_rows = Counter(), Counter()
    for _, host, path in given:
        if rule := plain_rule(host, path):
            n_rows[verdict[rule]] += 1
            counts.update((verdict[rule], w) for w in lexicon.words(host, path))
    vocabulary = {w for _, w in counts}
    total = {v: sum(n for (x, _), n in counts.items() if x == v) for v in ("block", "allow")}

    def score(words):
        p = {v: np.log(n_rows[v] + 1) + sum(np.log((counts[v, w] + 1) / (total[v] + len(vocabulary) + 1)) for w in words if w in vocabulary) for v in total}
        return p["block"] - p["allow"] if words else 0.0

    got = sorted(((r["page_id"], r["host"], r["path"], round(r["block_score"], 6), r["verdict"]) for r in url_filter.judge(frame).collect()), key=str)
    want = []
    for i, host, path in given:
        s, rule = score(lexicon.words(host, path)), plain_rule(host, path)
        want.append((i, host, path, round(s, 6) + 0.0, verdict[rule] if rule else "block" if s > 0 else "allow"))
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in sorted(want, key=str)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want, key=str)], atol=1e-5)


def test_segmentation_matches_brute_force():
    lexicon = url_filter.Lexicon({"casino": 30, "win": 20, "cas": 2, "in": 50, "o": 5, "best": 9}, 200)

    def splits(word):
        yield (word,)
        for i in range(1, len(word)):
            for rest in splits(word[i:]):
                yield (word[:i], *rest)

    for word in ("casinowin", "bestcasino", "winbestin", "zzwin", "ozzino", "xyz", "winzzzcas"):
        cost = lambda s: sum(map(lexicon.word_cost, s))
        assert abs(cost(lexicon.split(word)) - min(map(cost, splits(word)))) < 1e-9
    assert lexicon.split("zzwin") == ("zz", "win") and "".join(lexicon.split("q" * 3000 + "win")) == "q" * 3000 + "win"
