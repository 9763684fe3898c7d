"""Main text of web pages: boosted trees over DOM nodes with hierarchical decoding.

A page becomes a tree of elements. For each element boosted trees give the log
odds that its subtree holds main text, from tag, attribute tokens, depth,
subtree density, link share, sibling statistics and the ancestors' kinds. The
decoder then picks the labelling with the highest total log probability among
those where nothing below a dropped element is kept, by one pass up and one
pass down the tree. Only what browsers don't show as text (scripts, styles, `head`, controls and media) is dropped whatever the odds;
containers, forms and dialogs among them, are judged.

The model is fitted on `TRAINING_PAGES` generated pages whose parts are known
(semantic tags, marked or unmarked containers), a fixed bound; it needs no
labels from the input.

Defined results: a null or empty page, or one without main text, gives an empty
string; unclosed and misnested markup is repaired as browsers do for paragraphs
and lists; pages of any length are taken whole; repeated rows are treated alike;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import slices, table, texts_of

TRAINING_PAGES, SEED = 500, 7
#: Bytes of pages whose elements are scored together.
SLICE_BYTES = 1_000_000
#: Kinds of attribute tokens; a token counts if it is one of these words or begins with one of four letters or more.
ATTRIBUTE_KINDS = {
    "content": "article content main post entry story text prose body",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs",
    "header": "header head masthead banner logo topbar branding hero",
    "footer": "footer foot copyright legal colophon bottom",
    "sidebar": "sidebar side aside rail related widget trending recommended popular more",
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promotion adsense dfp outbrain taboola",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall dialog toast warning message",
    "form": "form search login signup signin register contact input",
    "comment": "comment comments reply replies respond disqus discussion thread responses",
    "social": "share sharing social follow like tweet buttons tags tools",
}
KINDS = {word: kind for kind, words in enumerate(ATTRIBUTE_KINDS.values()) for word in words.split()}
LONG_KINDS = [(w, k) for w, k in KINDS.items() if len(w) >= 4]
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes".split())
#: Elements whose content browsers don't show as text of the page.
NEVER = RAW | set("head select option optgroup button svg canvas audio video datalist".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
#: A start tag closes an open one of these, up to the given containers.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
TAG_FLAGS = ({"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"h1"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"}, {"a"}, {"div"}, {"section"}, {"article"}, {"main"}, {"nav"}, {"aside"}, {"header"}, {"footer"}, {"table", "tr", "td", "th", "tbody"}, {"blockquote", "pre", "figure", "figcaption"}, {"b", "i", "em", "strong", "span", "u", "small", "code"}, {"body"}, {"html"}, {"form", "fieldset"}, {"label", "legend", "output"}, {"dialog", "details", "summary"})
SEMANTIC = {"nav": 1, "header": 2, "footer": 3, "aside": 4}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")


def attribute_kinds(attributes: str) -> int:
    """Bits of the kinds that an element's attributes name; what is found for short ones is remembered."""
    return _short_kinds(attributes) if len(attributes) <= 200 else _kinds(attributes)


def _kinds(attributes: str) -> int:
    bits = 0
    for m in ATTRIBUTE.finditer(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()
        for word in WORD.findall(value):
            kind = KINDS.get(word)
            if kind is None:
                kind = next((k for w, k in LONG_KINDS if word.startswith(w)), None)
            if kind is not None:
                bits |= 1 << kind
    return bits


_short_kinds = lru_cache(20_000)(_kinds)


class Tree:
    """Elements in document order, and the page's texts with the element that holds each."""

    __slots__ = ("tags", "parents", "kinds", "texts", "stack", "open", "walls")

    def __init__(self, page: str):
        self.tags, self.parents, self.kinds = ["#root"], [-1], [0]
        self.texts: list[tuple[int, str | None]] = []  # (element, text); None is a block's edge
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # places on the stack by tag, so no tag is ever searched for
        self.walls: list[int] = []  # places of open blocks but paragraphs
        at, n = 0, len(page)
        while at < n:
            m = TOKEN.search(page, at)
            end = m.start() if m else n
            if end > at:
                self.texts.append((self.stack[-1], page[at:end]))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
                continue
            if tag in CLOSES_P:
                self.close_open({"p"}, self.walls[-1] if self.walls else 0)
            if tag in SIBLINGS:
                tags, within = SIBLINGS[tag]
                self.close_open(tags, self.top(within))
            if tag in BLOCK:
                self.texts.append((self.stack[-1], None))
            elif tag == "br":
                self.texts.append((self.stack[-1], " "))
            if tag in VOID:
                continue
            self.tags.append(tag)
            self.parents.append(self.stack[-1])
            self.kinds.append(attribute_kinds(m[3]) if m[3] else 0)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else n
            else:
                self.open.setdefault(tag, []).append(len(self.stack))
                if tag in BLOCK and tag != "p":
                    self.walls.append(len(self.stack))
                self.stack.append(len(self.tags) - 1)

    def top(self, tags: set[str]) -> int:
        """The highest place on the stack of an element with one of the tags; 0 for none."""
        return max((places[-1] for t in tags if (places := self.open.get(t))), default=0)

    def cut(self, place: int) -> None:
        """Closes what is open from a place on; each element is closed once."""
        while len(self.stack) > place:
            tag = self.tags[self.stack.pop()]
            self.open[tag].pop()
            if tag in BLOCK and tag != "p":
                self.walls.pop()

    def close(self, tag: str) -> None:
        place = self.top({tag})
        block = max(self.walls[-1] if self.walls else 0, self.top({"p"}))
        if not place or tag not in BLOCK and block > place:
            return  # not open, or an inline end tag, which doesn't close blocks
        if block >= place:
            self.texts.append((self.stack[-1], None))
        self.cut(place)

    def close_open(self, tags: set[str], wall: int) -> None:
        """Closes the highest of the tags that stands above a wall."""
        place = self.top(tags)
        if place > wall:
            self.texts.append((self.stack[-1], None))
            self.cut(place)


def features(tree: Tree) -> np.ndarray:
    """One row for each element."""
    n, parents = len(tree.tags), tree.parents
    own, words, stops, first = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    at = 0
    for node, text in tree.texts:
        if text is None:
            continue
        size = len(text)
        own[node] += size
        words[node] += text.count(" ")
        stops[node] += text.count(".") + text.count(",")
        at += size
    total = max(1.0, own.sum())
    up = np.asarray(parents)
    text, link, nodes, paragraphs, items = own.copy(), own * np.asarray([t == "a" for t in tree.tags]), np.ones(n), np.zeros(n), np.zeros(n)
    wordsum, stopsum = words.copy(), stops.copy()
    for i in range(n - 1, 0, -1):  # children stand behind their parents
        p, tag = parents[i], tree.tags[i]
        text[p] += text[i]
        link[p] += text[i] if tag == "a" else link[i]
        nodes[p] += nodes[i]
        wordsum[p] += wordsum[i]
        stopsum[p] += stopsum[i]
        paragraphs[p] += paragraphs[i] + (tag == "p")
        items[p] += items[i] + (tag == "li")
    depth, above, place, count, previous = np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
    last: dict[int, int] = {}
    kinds = np.asarray(tree.kinds)
    before = np.zeros(n)
    for i in range(1, n):
        p = parents[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | kinds[p] | (1 << SEMANTIC[tree.tags[p]] if tree.tags[p] in SEMANTIC else 0)
        if tree.tags[p] in ("article", "main"):
            above[i] |= 1
        place[i] = count[p]
        count[p] += 1
        if p in last:
            previous[i] = text[last[p]]
            before[i] = before[last[p]] + text[last[p]]
        else:
            before[i] = before[p]
        last[p] = i
    safe_up = np.maximum(up, 0)
    tag_rank = {t: k for k, tags in enumerate(TAG_FLAGS) for t in tags}
    ranks = np.asarray([tag_rank.get(t, -1) for t in tree.tags])
    columns = [ranks == k for k in range(len(TAG_FLAGS))]
    columns += [(kinds >> k) & 1 for k in range(len(ATTRIBUTE_KINDS))]
    columns += [(above >> k) & 1 for k in range(len(ATTRIBUTE_KINDS))]
    columns += [depth, np.log1p(nodes), np.log1p(text), np.log1p(own), text / nodes, link / np.maximum(text, 1), text / total, own / np.maximum(text, 1), stopsum / np.maximum(wordsum, 1), text / np.maximum(wordsum + 1, 1), np.log1p(paragraphs), np.log1p(items), paragraphs / nodes]
    columns += [place, count[safe_up], np.log1p(previous), text / np.maximum(text[safe_up], 1), (text[safe_up] - text) / np.maximum(count[safe_up] - 1, 1), link[safe_up] / np.maximum(text[safe_up], 1), before / total, np.log1p(text[safe_up])]
    return np.stack(columns, 1).astype(np.float64)


def decode(tree: Tree, odds: np.ndarray) -> list[bool]:
    """The likeliest consistent labels: below a dropped element all are dropped."""
    n, parents = len(tree.tags), tree.parents
    log_keep, log_drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    keep, drop = log_keep.tolist(), log_drop.tolist()
    for i in range(n):
        if tree.tags[i] in NEVER:
            keep[i] = -1e9
    for i in range(n - 1, 0, -1):
        p = parents[i]
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
    label = [True] * n
    for i in range(1, n):
        label[i] = label[parents[i]] and keep[i] > drop[i]
    return label


def kept_text(tree: Tree, label: list[bool]) -> str:
    blocks, part = [], []
    for node, text in tree.texts:
        if text is None:
            blocks.append("".join(part))
            part = []
        elif label[node]:
            part.append(text)
    blocks.append("".join(part))
    return "\n\n".join(b for b in (" ".join(unescape(x).split()) for x in blocks) if b)


# ------------------------------------------------------------------ generated training pages
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def sentence(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    words = [w + "," if rng.random() < 0.06 else w for w in words]
    return " ".join(words).capitalize() + rng.choice("...?!")


def prose(rng: random.Random, low: int = 1, high: int = 8) -> str:
    return " ".join(sentence(rng, 3, 25) for _ in range(rng.randint(low, high)))


def inline(rng: random.Random, text: str) -> str:
    roll = rng.random()
    if roll < 0.2:
        return f"<b>{text}<br>" if rng.random() < 0.5 else f"<strong>{text}</strong>"
    if roll < 0.4:
        cut = len(text) // 2
        return f'{text[:cut]}<a href="/x">{sentence(rng, 1, 3)}</a>{text[cut:]}'
    return text


MARK = "data-main"


def marked(rng: random.Random, names: str) -> str:
    name = rng.choice(names.split())
    name = rng.choice((name, name, f"{name}-{rng.choice(('box', 'wrap', 'block', 'area', '1', 'list'))}", f"site-{name}", f"{name} {rng.choice(('c1', 'grid', 'x9'))}"))
    return f' {rng.choice(("class", "class", "id"))}="{name}"'


def links(rng: random.Random) -> str:
    n = rng.randint(2, 12)
    if rng.random() < 0.75:
        return "<ul>" + "".join(f'<li><a href="/{i}">{sentence(rng, 1, 3)[:-1]}</a></li>' for i in range(n)) + "</ul>"
    return rng.choice((" | ", " ", "<br>")).join(f'<a href="/{i}">{sentence(rng, 1, 3)[:-1]}</a>' for i in range(n))


def boilerplate(rng: random.Random, kind: str) -> str:
    """A part that is no main text."""
    div = rng.choice(("div", "div", "section"))
    words = ATTRIBUTE_KINDS
    if kind == "menu":
        return rng.choice((f"<nav>{links(rng)}</nav>", f"<nav{marked(rng, words[kind])}>{links(rng)}</nav>", f"<div{marked(rng, words[kind])}>{links(rng)}</div>"))
    if kind == "header":
        inner = rng.choice((f"<a href='/'>{sentence(rng, 1, 3)}</a>", f"<p>{sentence(rng, 2, 8)}</p>", f"<h2>{sentence(rng, 1, 4)}</h2>{links(rng)}"))
        return rng.choice((f"<header>{inner}</header>", f"<header{marked(rng, words[kind])}>{inner}</header>", f"<div{marked(rng, words[kind])}>{inner}</div>"))
    if kind == "footer":
        inner = rng.choice((f"&copy; {sentence(rng, 2, 12)}", f"<p>&copy; 2020 {sentence(rng, 2, 12)}</p>", f"{links(rng)}<p>{prose(rng, 1, 2)}</p>", f"{prose(rng, 1, 3)}"))
        return rng.choice((f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{marked(rng, words[kind])}>{inner}</div>"))
    if kind == "sidebar":
        inner = rng.choice((f"<h3>{sentence(rng, 1, 4)}</h3>{links(rng)}", f"<p>{prose(rng, 1, 3)}</p>", f"<h4>{sentence(rng, 1, 3)}</h4><p>{prose(rng, 1, 4)}</p>{links(rng)}"))
        return rng.choice((f"<aside>{inner}</aside>", f"<aside{marked(rng, words[kind])}>{inner}</aside>", f"<{div}{marked(rng, words[kind])}>{inner}</{div}>"))
    if kind == "form":
        inner = rng.choice((f"<p>{sentence(rng, 2, 10)}</p>", f"<fieldset><legend>{sentence(rng, 1, 3)}</legend>{sentence(rng, 2, 9)}</fieldset>", f"<h3>{sentence(rng, 1, 4)}</h3><p>{prose(rng, 1, 2)}</p>")) + f"<label>{sentence(rng, 1, 2)}</label><input name=q><button>{sentence(rng, 1, 2)}</button>"
        return rng.choice((f"<form{marked(rng, words[kind])}>{inner}</form>", f"<div{marked(rng, words[kind])}><form>{inner}</form></div>"))
    if kind == "comment":
        one = lambda: f"<{rng.choice(('div', 'li', 'article'))}{marked(rng, 'comment reply')}><b>{sentence(rng, 1, 2)}</b> <p>{prose(rng, 1, 4)}</p>"
        body = "".join(one() + "</div>" for _ in range(rng.randint(1, 6))).replace("<li", "<div").replace("<article", "<div")
        return f"<{div}{marked(rng, words[kind])}>{f'<h3>{sentence(rng, 1, 3)}</h3>' * rng.randint(0, 1)}{body}</{div}>"
    inner = rng.choice((sentence(rng, 2, 14), prose(rng, 1, 3), f"<p>{prose(rng, 1, 3)}</p>", f"<p>{sentence(rng, 3, 12)} <a href='#'>{sentence(rng, 1, 2)}</a></p>"))
    return f"<{div}{marked(rng, words[kind])}>{inner}</{div}>"


def main_part(rng: random.Random) -> str:
    """An article: its elements carry MARK."""
    parts = []
    for i in range(rng.randint(1, 14)):
        roll = rng.random()
        if i == 0 and rng.random() < 0.8:
            parts.append(f"<h1 {MARK}>{sentence(rng, 1, 12)}</h1>")
        elif roll < 0.08:
            parts.append(f"<h{rng.randint(2, 4)} {MARK}>{sentence(rng, 1, 7)}</h2>")
        elif roll < 0.13:
            parts.append(f"<ul {MARK}>" + "".join(f"<li {MARK}>{prose(rng, 1, 2)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif roll < 0.17:
            parts.append(f"<blockquote {MARK}><p {MARK}>{prose(rng, 1, 3)}</p></blockquote>")
        elif roll < 0.19:
            parts.append(f"<table {MARK}><tr {MARK}><td {MARK}>{sentence(rng, 1, 5)}</td><td {MARK}>{sentence(rng, 1, 5)}</td></tr></table>")
        elif roll < 0.25:
            parts.append(boilerplate(rng, rng.choice(("advert", "advert", "social", "notice", "sidebar"))))
        else:
            parts.append(f"<p {MARK}>{inline(rng, prose(rng, 1, rng.choice((1, 3, 8, 20))))}</p>")
    body = "".join(parts)
    roll = rng.random()
    if roll < 0.55:
        body = f"<article {MARK}{marked(rng, ATTRIBUTE_KINDS['content']) if rng.random() < 0.3 else ''}>{body}</article>"
    elif roll < 0.8:
        body = f"<div {MARK}{marked(rng, ATTRIBUTE_KINDS['content'])}>{body}</div>"
    elif roll < 0.95:
        body = f"<div {MARK}>{body}</div>"
    return f"<main {MARK}>{body}</main>" if rng.random() < 0.25 else body


def training_page(rng: random.Random) -> str:
    before = [boilerplate(rng, k) for k in ("menu", "header", "advert", "notice", "sidebar", "form") if rng.random() < 0.45]
    after = [boilerplate(rng, k) for k in ("comment", "sidebar", "advert", "form", "social", "notice") if rng.random() < 0.35]
    rng.shuffle(before)
    rng.shuffle(after)
    body = "".join([*before, main_part(rng), *after]) + (boilerplate(rng, "footer") if rng.random() < 0.85 else "")
    if rng.random() < 0.4:
        body = f"<div {MARK} class='wrapper'>{body}</div>"
    if rng.random() < 0.15:  # as frameworks wrap a whole page
        body = f"<form {MARK} method=post id='{rng.choice(('form1', 'aspnetForm', 'f0'))}'><input type=hidden name=s>{body}</form>"
    return f"<!DOCTYPE html><html {MARK}><head><title>{sentence(rng, 1, 9)}</title><script>var a = '<p>';</script></head><body {MARK}>{body}</body></html>"


@lru_cache(1)
def fitted_model() -> BoostedTrees:
    rng, xs, ys = random.Random(SEED), [], []
    for _ in range(TRAINING_PAGES):
        page = training_page(rng)
        labels = [MARK in (m[3] or "") for m in TOKEN.finditer(re.sub(r"(?s)<(script|title)>.*?</\1>", r"<\1></\1>", page)) if m[2] and not m[1] and m[2].lower() not in VOID]
        tree = Tree(page)
        label = np.asarray([True, *labels])
        for i in range(1, len(label)):  # inline elements inside kept ones are kept
            if tree.tags[i] in ("a", "b", "strong") and label[tree.parents[i]]:
                label[i] = True
        xs.append(features(tree))
        ys.append(label)
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract_pages(pages: list[str | None], model: BoostedTrees) -> list[str]:
    trees = [Tree(p or "") for p in pages]
    rows = [features(t) for t in trees]
    odds = model.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for tree, x in zip(trees, rows):
        out.append(kept_text(tree, decode(tree, odds[at : at + len(x)])))
        at += len(x)
    return out


def extract_batches(model: BoostedTrees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", SLICE_BYTES):
                text = extract_pages([None if p is None else p.decode("utf-8", "replace") for p in texts_of(batch, "html")], model)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(extract_batches(fitted_model()), "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
