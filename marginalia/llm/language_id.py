"""Language identification: a linear-chain conditional random field over words.

Each word of a text gets a language label. A word's emission scores are sums of
learned weights of its features: affixes, character n-grams and, for words
frequent in the training sample, the word itself (the lexicon). Learned
transition weights tie neighbours, so code-switched text is labelled in runs.
Forward-backward gives each word's marginals; a document's language is the one
with the largest share of letters under them, and that share is the score.

Fitting maximises the conditional likelihood of label sequences, by AdaGrad,
on about `TRAINING_DOCS` documents for each language (chosen by a hash of the
id among the labelled training documents), of each at most `TRAINING_CHARS` characters from a place that a hash chooses. Of more than
`MOST_LANGUAGES` languages in the training rows the most frequent are learned, and no text is given another.

Words are split at ASCII white space, and those of more than `LONGEST` letters into
successive pieces of so many, each a word of its own; only letters count for features. A text
is one chain, labelled in segments of `SEGMENT` words: what a segment's words before and behind it say reaches
it through the segments' transfer matrices, so the marginals are those of the whole chain, while
a text of any length takes bounded memory.

Defined results: `und` and score 0 if the text is null or has no letter; if no
training row has a label, every text is `und`. Repeated rows get equal results;
ties take the first label in order; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, batch_rows, doc_mod, held, kept_table, mix, slices, table, texts_of, trim

#: Bounds of the training sample: documents for each language, words taken as one sequence, sequences in all.
TRAINING_DOCS, TRAINING_CHARS, SEQUENCE, SEQUENCES = 300, 20_000, 40, 6000
MOST_LANGUAGES = 200
#: Words labelled in one run of forward-backward.
SEGMENT = 512
#: Letters of a word; longer ones are cut into pieces.
LONGEST = 40
LEXICON_WORDS, HASH_BITS = 2000, 16
EPOCHS, RATE, L2 = 4, 0.5, 1e-6
UNKNOWN = "und"
#: The least share of a text that its language must have to pass keep().
LEAST_SCORE = 0.4
NO_LETTER = re.compile(r"[\W\d_]+")
#: Up to LONGEST letters, with the other characters before the first and behind each.
PIECE = re.compile(r"[\W\d_]*(?:[^\W\d_][\W\d_]*){1,%d}" % LONGEST)


def words_of(text: str) -> list[str]:
    """Words, the long ones in pieces."""
    return [x for w in text.split() for x in ([w] if len(w) <= LONGEST else PIECE.findall(w) or [w])]


def byte_words_of(text: bytes) -> list[bytes]:
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [x for w in words for x in ([w] if len(w) <= LONGEST else [p.encode() for p in PIECE.findall(w.decode("utf-8", "replace"))] or [w])]


def word_features(words: list[str], lexicon: frozenset | set) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: which word each belongs to, and the feature. A word without letters has none."""
    letters = [NO_LETTER.sub("", w).lower() for w in words]
    which = np.asarray([i for i, x in enumerate(letters) if x], np.int64)
    padded = [f"^{x}$" for x in letters if x]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.asarray([len(x) for x in padded], np.int64)
    word = np.repeat(np.arange(len(padded)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    owners, found = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, 6):  # n-grams; those with ^ or $ are affixes, of five characters only these
        ahead = np.zeros(len(codes), np.uint64)
        ahead[: max(0, len(codes) - n + 1)] = codes[n - 1 :]
        h = h * np.uint64(0x100000001B3) + ahead + np.uint64(n)
        valid = left >= n if n < 5 else left == n
        owners.append(word[valid])
        found.append(mix(h[valid]) & np.uint64((1 << HASH_BITS) - 1))
    frequent = [(k, zlib.crc32(x.encode()) & ((1 << HASH_BITS) - 1)) for k, x in enumerate(x[1:-1] for x in padded) if x in lexicon]
    owners.append(np.asarray([k for k, _ in frequent], np.int64))
    found.append(np.asarray([f for _, f in frequent], np.uint64))
    return which[np.concatenate(owners)] if len(which) else which, np.concatenate(found).astype(np.int64)


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (rows x time x labels) and summed pair marginals, for rows sorted by falling length.

    emission and transition hold log weights. Probabilities are scaled at each step. before and behind (rows x labels) are what
    the chain says at a row's first word without it, and at its last word of what follows.
    """
    rows, steps, labels = emission.shape
    e = np.exp(emission - emission.max(2, keepdims=True))
    t = np.exp(transition)
    active = [int(np.searchsorted(-lengths, -s, side="left")) for s in range(steps)]  # rows longer than s
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    if behind is not None:
        beta[np.arange(rows), lengths - 1] = behind
    for s in range(steps):
        k = active[s]
        a = e[:k, s] * (alpha[:k, s - 1] @ t if s else 1.0 if before is None else before[:k])
        alpha[:k, s] = a / a.sum(1, keepdims=True)
    pairs = np.zeros_like(t)
    for s in range(steps - 2, -1, -1):
        k = active[s + 1]
        ahead = e[:k, s + 1] * beta[:k, s + 1]
        b = ahead @ t.T
        beta[:k, s] = b / b.sum(1, keepdims=True)
        z = ((alpha[:k, s] @ t) * ahead).sum(1)
        pairs += t * (alpha[:k, s].T @ (ahead / z[:, None]))
    gamma = alpha * beta
    return gamma / np.maximum(gamma.sum(2, keepdims=True), 1e-300), pairs


def transfer(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """rows x labels x labels, for rows of one length: from what stands at a row's first word without it to the same at its last word with all words. Scaled."""
    e = np.exp(emission - emission.max(2, keepdims=True))
    t = np.exp(transition)
    out = np.eye(emission.shape[2])[None] * e[:, :1]
    for s in range(1, emission.shape[1]):
        out = (out @ t) * e[:, s, None, :]
        if s % 16 == 0:
            out /= out.max((1, 2), keepdims=True)
    return out / out.max((1, 2), keepdims=True)


class Model:
    """Weights, labels and lexicon of a fitted field."""

    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray, lexicon: frozenset):
        self.labels, self.weights, self.transition, self.lexicon = labels, weights, transition, lexicon
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(labels)), np.float32)
        self.letters = np.zeros(1024, np.int32)

    def __reduce__(self):
        return Model, (self.labels, self.weights, self.transition, self.lexicon)

    def forget(self) -> None:
        """Drops the scores of the words met so far."""
        self.__init__(self.labels, self.weights, self.transition, self.lexicon)

    def learn(self, words: list[bytes]) -> None:
        """Adds the emission scores of unseen words."""
        at, size = len(self.rows), len(self.rows) + len(words)
        while len(self.table) < size:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        texts = [w.decode("utf-8", "replace") for w in words]
        owner, found = word_features(texts, self.lexicon)
        for j in range(len(self.labels)):
            self.table[at:size, j] = np.bincount(owner, self.weights[found, j], len(words))
        self.letters[at:size] = [len(t) if t.isalpha() else sum(map(str.isalpha, t)) for t in texts]
        self.rows.update(zip(words, range(at, size)))

    def marginals(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """For each text its words' marginals."""
        return [np.concatenate(parts) if parts else np.zeros((0, len(self.labels))) for parts, _ in self._run(texts)]

    def _run(self, texts: list[bytes | None]) -> list[tuple[list[np.ndarray], list[np.ndarray]]]:
        out: list[tuple[list, list]] = [([], []) for _ in texts]
        pieces = []
        split = [byte_words_of(text or b"") for text in texts]
        new = set().union(*split)
        if len(self.rows) + len(new) > CACHE_ENTRIES:
            self.forget()
        self.learn(sorted(new.difference(self.rows)))
        get = self.rows.__getitem__
        for i, words in enumerate(split):
            rows = np.fromiter(map(get, words), np.int64, len(words))
            pieces += [(i, at, rows[at : at + SEGMENT]) for at in range(0, len(rows), SEGMENT)]
        before, behind = self._edges(pieces)
        order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k][2]))
        done: dict[int, np.ndarray] = {}
        for at in range(0, len(order), 256):
            block = order[at : at + 256]
            lengths = np.asarray([len(pieces[k][2]) for k in block])
            index = np.zeros((len(block), lengths[0]), np.int64)
            for r, k in enumerate(block):
                index[r, : lengths[r]] = pieces[k][2]
            gamma, _ = forward_backward(self.table[index].astype(np.float64), lengths, self.transition, before[block], behind[block])
            for r, k in enumerate(block):
                done[k] = gamma[r, : lengths[r]]
        for k, (i, _, rows) in enumerate(pieces):
            out[i][0].append(done[k])
            out[i][1].append(self.letters[rows])
        return out

    def _edges(self, pieces: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """What the rest of its text says at each piece's first word and behind its last; the pieces of a text stand in order."""
        n, t = len(self.labels), np.exp(self.transition)
        before, behind = np.ones((len(pieces), n)), np.ones((len(pieces), n))
        long = [k for k in range(len(pieces)) if k + 1 < len(pieces) and pieces[k + 1][0] == pieces[k][0] or pieces[k][1]]
        moves: dict[int, np.ndarray] = {}
        full = [k for k in long if len(pieces[k][2]) == SEGMENT]  # all but a text's last
        step = max(1, 2_000_000 // (SEGMENT * n + n * n))
        for at in range(0, len(full), step):
            block = full[at : at + step]
            moves.update(zip(block, transfer(self.table[np.stack([pieces[k][2] for k in block])].astype(np.float64), self.transition)))
        last = [k for k in long if len(pieces[k][2]) < SEGMENT]
        moves.update((k, transfer(self.table[pieces[k][2]][None].astype(np.float64), self.transition)[0]) for k in last)
        for k in long:
            if pieces[k][1]:
                v = before[k - 1] @ moves[k - 1] @ t
                before[k] = v / v.max()
        for k in reversed(long):
            if k + 1 < len(pieces) and pieces[k + 1][0] == pieces[k][0]:
                v = t @ (moves[k + 1] @ behind[k + 1])
                behind[k] = v / v.max()
        return before, behind

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        if not self.labels:
            return [(UNKNOWN, 0.0)] * len(texts)
        out = []
        for parts, letters in self._run(texts):
            weight = sum((n[:, None] * g).sum(0) for g, n in zip(parts, letters)) if parts else np.zeros(1)
            total = weight.sum()
            out.append((self.labels[int(weight.argmax())], float(weight.max() / total)) if total > 0 else (UNKNOWN, 0.0))
        return out


def fit(samples: list[tuple[str, str]]) -> Model:
    """From (text, language) pairs; the order given doesn't matter."""
    samples = sorted(samples)
    labels = sorted({lang for _, lang in samples})
    by_lang: dict[str, Counter] = defaultdict(Counter)
    for text, lang in samples:
        by_lang[lang].update(NO_LETTER.sub("", w).lower() for w in words_of(text))
    lexicon = frozenset(w for lang in labels for w, n in sorted(by_lang[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS] if w and n > 1)
    n = len(labels)
    weights, transition = np.zeros((1 << HASH_BITS, n)), np.zeros((n, n))
    if n < 2:
        return Model(labels, weights, transition, lexicon)
    rng = np.random.default_rng(5)
    chunks = [(words[at : at + SEQUENCE], labels.index(lang)) for text, lang in samples for words in [words_of(text)] for at in range(0, len(words), SEQUENCE)]
    chunks = [chunks[i] for i in rng.permutation(len(chunks))[:SEQUENCES]]
    # neighbouring sequences of two languages, joined, show how languages switch
    joined = [(a + b, [x] * len(a) + [y] * len(b)) for (a, x), (b, y) in zip(chunks[::8], chunks[1::8])]
    sequences = [(words, [lang] * len(words)) for words, lang in chunks] + joined
    distinct = sorted({w for words, _ in sequences for w in words})
    owner, feature = word_features(distinct, lexicon)
    by_word = np.argsort(owner, kind="stable")
    known = dict(zip(distinct, np.split(feature[by_word], np.cumsum(np.bincount(owner, minlength=len(distinct)))[:-1])))
    squares, squares_t = np.full_like(weights, 1e-8), np.full_like(transition, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), 128):
            block = sorted((sequences[i] for i in order[at : at + 128]), key=lambda s: -len(s[0]))
            lengths = np.asarray([len(w) for w, _ in block])
            flat = [known[w] for words, _ in block for w in words]
            counts = np.asarray([len(f) for f in flat])
            features = np.concatenate(flat) if len(flat) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(flat)), counts)
            word_scores = np.stack([np.bincount(owner, weights[features, j], len(flat)) for j in range(n)], 1)
            mask = np.arange(lengths[0])[None, :] < lengths[:, None]
            emission = np.zeros((len(block), lengths[0], n))
            emission[mask] = word_scores
            gamma, pairs = forward_backward(emission, lengths, transition)
            truth = np.concatenate([np.asarray(y) for _, y in block])
            error = -gamma[mask]
            error[np.arange(len(truth)), truth] += 1
            gradient = np.stack([np.bincount(features, error[owner, j], len(weights)) for j in range(n)], 1) / len(block)
            pair_truth = np.zeros_like(transition)
            for _, y in block:
                np.add.at(pair_truth, (y[:-1], y[1:]), 1)
            gradient_t = (pair_truth - pairs) / len(block)
            gradient -= L2 * weights
            squares += gradient**2
            squares_t += gradient_t**2
            weights += RATE * gradient / np.sqrt(squares)
            transition += RATE * gradient_t / np.sqrt(squares_t)
    return Model(labels, weights.astype(np.float32).astype(np.float64), transition, lexicon)


def training_rows(docs: DataFrame, per_language: int = TRAINING_DOCS) -> list[tuple[str, str]]:
    """About per_language documents of each label among the training rows: those with the smallest hashes of their ids. Of more than MOST_LANGUAGES labels the most frequent are learned."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (doc_mod("doc_id", 4) != 2))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return []
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(share)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / F.lit(1 << 32)
    room = F.greatest(F.length("text") - TRAINING_CHARS, F.lit(0)) + 1
    part = F.substring("text", (F.pmod(F.xxhash64("text"), room) + 1).cast("int"), F.lit(TRAINING_CHARS))
    chosen = labelled.filter(spread < share).select(part.alias("text"), "lang").orderBy(F.xxhash64("text"), "text", "lang").limit(2 * per_language * len(counts))
    return [(r["text"], r["lang"]) for r in chosen.collect()]


def fit_on(docs: DataFrame) -> Model:
    return fit(training_rows(docs))


def predict_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language", dict)
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                found = model.value.predict(texts_of(batch, "text"))
                kept = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*kept, "lang_pred", "score"])
        model.value.forget()
        trim()

    return run


def label_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, and lang to fit on)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_on(docs))  # its size is fixed by HASH_BITS, LEXICON_WORDS and MOST_LANGUAGES
    out = rows.mapInArrow(predict_batches(shared), "doc_id long, lang_pred string, score double")
    return out.withColumn("held_out", F.coalesce(doc_mod("doc_id", 4) == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def keep_batches(model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language", dict)
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in model.value.predict(texts_of(batch, "text"))], pa.bool_()))
        model.value.forget()
        trim()

    return run


def keep(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """A table of the rows of docs (doc_id, text, lang) in a language with a score of least or more, with all their columns.

    Rejected are texts without a letter and those in which no language has that share.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_on(docs))
    with batch_rows(docs.sparkSession):
        return kept_table(docs.mapInArrow(keep_batches(model, least), docs.schema), "languages")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_documents(table(spark, sf_dir, "documents"))
