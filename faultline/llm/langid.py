"""Language identification of words and documents with a linear-chain CRF.

Every word gets a score per language from its affixes, character n-grams and
lexicon entries; learned transitions say how likely the language changes from
one word to the next.  Forward-backward over all words of a text gives each
word's language probabilities, also in code-switched text; a document's score
for a language is the mean probability of its words.

The model is fitted on a bounded sample of labelled documents (``TRAIN_DOCS``
a language at most on average, chosen by a hash of the id, each of at most
``TRAIN_CHARS`` characters).  As labels are per document, training chains are
spliced from runs of several documents, so that transitions are learned on
switches too.  Prediction reads every word of every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, release, small_batches, text_or_empty

WORDS = re.compile(r"[^\W\d_]+")
TRAIN_DOCS = 250
TRAIN_CHARS = 50_000
MAX_FEATURES = 1 << 16
LEXICON = 4000  # most frequent training words that are features of their own
CHAIN = 64
EPOCHS = 3
BATCH = 256
RATE = 0.25
SEED = 42
STEP = 32  # words in a block of the scan
UNKNOWN = "und"
SPLIT_WORDS = 200_000  # words scored at once
MEMO = 300_000


def features(word: str, lexicon: frozenset | None) -> list[str]:
    """Affixes, inner bigrams and trigrams, and the word itself if listed."""
    out = ["^" + word[:k] for k in (1, 2, 3)[: len(word)]] + [word[-k:] + "$" for k in (1, 2, 3)[: len(word)]]
    out += {word[i:i + n] for n in (2, 3) for i in range(len(word) - n + 1)}
    if lexicon is None or word in lexicon:
        out.append("=" + word)
    return out


@dataclass
class Model:
    languages: list[str]
    index: dict[str, int]  # feature -> row of weights
    lexicon: frozenset
    weights: np.ndarray  # (features, languages)
    moves: np.ndarray  # exp(transition scores)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each word for each language."""
        flat, at = flat_features(words, self.index, self.lexicon)
        return row_sums(self.weights[flat], at)


def flat_features(words: list[str], index: dict[str, int], lexicon: frozenset) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all words, one after the other, and where each word ends."""
    flat: list[int] = []
    ends = np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        flat.extend(k for f in features(w, lexicon) if (k := index.get(f)) is not None)
        ends[i] = len(flat)
    return np.array(flat, np.int64), ends


def row_sums(rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros((len(rows) + 1, rows.shape[1]), np.float64)
    np.cumsum(rows, axis=0, out=total[1:])
    return (total[ends] - total[np.r_[0, ends[:-1]]] if len(ends) else total[:0]).astype(np.float32)


# --- forward-backward ------------------------------------------------------

def chains(e: np.ndarray, valid: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward vectors of K chains of T words (``e``: K, T,
    L).  ``first`` stands before the first word, ``last`` after the last; words
    that are not ``valid`` (at the end) change nothing."""
    k, t, n = e.shape
    fwd, bwd = np.empty_like(e), np.empty_like(e)
    a = first
    for i in range(t):
        b = (a @ moves) * e[:, i]
        b /= b.sum(1, keepdims=True)
        a = np.where(valid[:, i, None], b, a)
        fwd[:, i] = a
    a = last
    for i in reversed(range(t)):
        bwd[:, i] = a
        b = (e[:, i] * a) @ moves.T
        b /= b.sum(1, keepdims=True)
        a = np.where(valid[:, i, None], b, a)
    return fwd, bwd


def posteriors(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Language probabilities of each word of texts laid end to end.

    Exact forward-backward, in blocks of ``STEP`` words: the product of each
    block's transfer matrices, a scan over the blocks of each text, then the
    words inside all blocks at once."""
    n = scores.shape[1]
    blocks = -(-sizes // STEP)
    k = int(blocks.sum())
    text_of = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(k) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = (np.cumsum(sizes) - sizes)[text_of] + nth * STEP
    count = np.minimum(STEP, sizes[text_of] - nth * STEP)
    valid = np.arange(STEP) < count[:, None]
    place = np.where(valid, start[:, None] + np.arange(STEP), 0)
    e = np.exp(scores - scores.max(1, keepdims=True))[place]
    through = np.broadcast_to(np.eye(n, dtype=e.dtype), (k, n, n)).copy()
    for i in range(STEP):
        step = (through.reshape(-1, n) @ moves).reshape(k, n, n) * e[:, i, None, :]
        step /= step.sum((1, 2), keepdims=True)
        through = np.where(valid[:, i, None, None], step, through)
    first, last = np.full((k, n), 1 / n, e.dtype), np.ones((k, n), e.dtype)
    order = np.argsort(nth, kind="stable")
    upto = np.searchsorted(nth[order], np.arange(nth.max(initial=0) + 2))
    for i in range(1, len(upto) - 1):  # texts that have an i-th block
        own = order[upto[i]:upto[i + 1]]
        a = np.einsum("ki,kij->kj", first[own - 1], through[own - 1])
        first[own] = a / a.sum(1, keepdims=True)
    for i in reversed(range(1, len(upto) - 1)):
        own = order[upto[i]:upto[i + 1]]
        a = np.einsum("kij,kj->ki", through[own], last[own])
        last[own - 1] = a / a.sum(1, keepdims=True)
    fwd, bwd = chains(e, valid, moves, first, last)
    p = fwd * bwd
    p /= p.sum(2, keepdims=True)
    return p[valid]


# --- training --------------------------------------------------------------

def fit(texts: list[str], labels: list[str], seed: int = SEED) -> Model | None:
    """A model from labelled texts; None if there is no labelled word."""
    rng = np.random.default_rng(seed)
    split = [WORDS.findall(t.lower()) for t in texts]
    languages = sorted({c for c, w in zip(labels, split, strict=True) if w})
    if not languages:
        return None
    often = Counter(w for words in split for w in words)
    lexicon = frozenset(w for w, c in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if c > 1)
    vocabulary = sorted(often)
    seen: Counter = Counter()
    for w in vocabulary:
        seen.update(features(w, lexicon))
    names = [f for f, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:MAX_FEATURES]]
    index = {f: i for i, f in enumerate(names)}
    number = {w: i for i, w in enumerate(vocabulary)}
    flat, ends = flat_features(vocabulary, index, lexicon)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.r_[0, ends]))
    by_feature = np.argsort(flat, kind="stable")
    f_ends = np.searchsorted(flat[by_feature], np.arange(len(names)), side="right")

    label_of = {c: i for i, c in enumerate(languages)}
    runs = []
    for words, c in zip(split, labels, strict=True):
        at = 0
        while at < len(words):
            size = int(rng.integers(4, CHAIN + 1))
            runs.append((words[at:at + size], label_of[c]))
            at += size
    order = rng.permutation(len(runs))
    w = np.array([number[x] for i in order for x in runs[i][0]], np.int64)
    y = np.repeat([runs[i][1] for i in order], [len(runs[i][0]) for i in order])
    k = -(-len(w) // CHAIN)
    valid = (np.arange(k * CHAIN) < len(w)).reshape(k, CHAIN)
    w, y = (np.r_[x, np.zeros(k * CHAIN - len(x), np.int64)].reshape(k, CHAIN) for x in (w, y))

    n = len(languages)
    weights, trans = np.zeros((len(names), n), np.float32), np.zeros((n, n), np.float32)
    w_sum, t_sum = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    for _ in range(EPOCHS):
        shuffled = rng.permutation(k)
        for at in range(0, k, BATCH):
            own = shuffled[at:at + BATCH]
            words, mask = w[own], valid[own]
            scores = row_sums(weights[flat], ends)[words]
            e, moves = np.exp(scores - scores.max(2, keepdims=True)), np.exp(trans)
            b = len(own)
            fwd, bwd = chains(e, mask, moves, np.full((b, n), 1 / n, e.dtype), np.ones((b, n), e.dtype))
            p = fwd * bwd
            p /= p.sum(2, keepdims=True)
            truth = np.eye(n, dtype=np.float32)[y[own]]
            miss = ((truth - p) * mask[..., None])[mask]
            per_word = np.stack([np.bincount(words[mask], miss[:, c], len(vocabulary)) for c in range(n)], 1)
            grad = row_sums(per_word[owner[by_feature]], f_ends) / b - 1e-4 * weights
            pair = mask[:, 1:]
            v, u = fwd[:, :-1][pair], (e * bwd)[:, 1:][pair]
            share = v / ((v @ moves) * u).sum(1, keepdims=True)
            t_grad = (truth[:, :-1][pair].T @ truth[:, 1:][pair] - (share.T @ u) * moves) / b - 1e-3 * trans
            w_sum += grad * grad
            t_sum += t_grad * t_grad
            weights += RATE * grad / np.sqrt(w_sum)
            trans += RATE * t_grad / np.sqrt(t_sum)
    return Model(languages, index, lexicon, weights, np.exp(trans).astype(np.float32))


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Model | None:
    """Fit on documents with a language that are not held out.  Each language
    is thinned by a hash of id and text to about ``per_language`` documents.
    Rows that repeat both fall together; they are cut at twice that number a
    language, so the sample that reaches the driver does not grow with the table."""
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    pool = docs.filter(lang.isNotNull() & text.isNotNull() & ~held_out(id_col) & (F.length(text) <= max_chars))
    counts = {r[0]: r[1] for r in pool.groupBy(lang.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    rate = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, per_language / n))])[lang]
    place = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(SEED)), F.lit(1 << 20)) / (1 << 20)
    sample = pool.filter(place < rate).groupBy(text.alias("t"), lang.alias("l")).agg(F.count(F.lit(1)).alias("n"))
    # Equal rows travel as one; texts stay in the order of their hash until a language has enough.
    upto = F.sum("n").over(Window.partitionBy("l").orderBy(F.xxhash64("t", F.lit(SEED)), "t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    most = 2 * per_language
    sample = sample.withColumn("before", upto - F.col("n")).filter(F.col("before") < most)
    rows = sample.select("t", "l", F.least("n", most - F.col("before")).alias("n")).collect()
    rows = sorted((r[0], r[1]) for r in rows for _ in range(r[2]))
    return fit([r[0] for r in rows], [r[1] for r in rows])


# --- prediction ------------------------------------------------------------

class Labeller:
    """Scores texts with a model; remembers the scores of words, up to ``MEMO`` of them."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.scores = np.empty((0, len(model.languages)), np.float32)

    def rows_of(self, words: list[str]) -> np.ndarray:
        new = sorted({w for w in set(words) if w not in self.known})
        if new:
            if len(self.known) > MEMO:
                self.known, self.scores = {}, self.scores[:0]
                new = sorted(set(words))
            # Characters like superscript digits match the pattern but are no letters.
            self.known.update({w: len(self.scores) + i if any(map(str.isalpha, w)) else -1 for i, w in enumerate(new)})
            self.scores = np.concatenate([self.scores, self.model.emissions(new)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """Language probabilities of the words of each text."""
        rows, sizes = [], []
        flat = [WORDS.findall(t.lower()) for t in texts]
        every = self.rows_of([w for words in flat for w in words])
        for words, at in zip(flat, np.cumsum([0, *map(len, flat)]), strict=False):
            own = every[at:at + len(words)]
            own = own[own >= 0]
            rows.append(own)
            sizes.append(len(own))
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        if not len(rows):
            return [np.empty((0, self.scores.shape[1]), np.float32) for _ in texts]
        p = posteriors(self.scores[rows], np.array(sizes, np.int64), self.model.moves)
        return np.split(p, np.cumsum(sizes)[:-1])

    def documents(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        part: list[str] = []
        size = 0
        for i, t in enumerate(texts):
            part.append(t)
            size += len(t) // 6
            if size >= SPLIT_WORDS or i == len(texts) - 1:
                for p in self.words(part):
                    mean = p.mean(0, dtype=np.float64) if len(p) else None
                    best = None if mean is None else int(mean.argmax())
                    out.append((UNKNOWN, 0.0) if mean is None else (self.model.languages[best], round(min(1.0, float(mean[best])), 4)))
                part, size = [], 0
        return out


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score): one row per row of ``docs``; the text
    alone decides.  ``und`` with score 0.0 for null texts, texts without a
    letter, and every text when nothing could be learned.  Repeated rows and
    equal texts get equal results; an empty table gives no rows; other columns
    are ignored."""
    state: list = []

    def work(ids, held, texts):
        if model is None:
            found = [(UNKNOWN, 0.0)] * len(texts)
        else:
            if not state:
                state.append(Labeller(model))
            found = state[0].documents(texts)
        return ids, held, [f[0] for f in found], [f[1] for f in found]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [F.col(f"`{id_col}`"), held_out(id_col), text_or_empty(text_col)], work,
                     f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


#: Only texts in which no language stands out are rejected; code-switched ones stay.
MIN_SCORE = 0.3


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of ``docs`` (all columns) whose text has a language with at least
    ``min_score``; null texts, texts without a letter, and everything when
    nothing could be learned go.  Rows are judged where they are read."""
    def identified(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lab = None if model is None else Labeller(model)
        try:
            for texts in batches:
                if lab is None:
                    yield pd.Series([False] * len(texts))
                else:
                    yield pd.Series([c != UNKNOWN and s >= min_score for c, s in lab.documents(list(texts))], dtype=bool)
        finally:
            lab = texts = None  # remembered words go with the task
            release()

    small_batches(docs.sparkSession)
    return docs.filter(F.pandas_udf(identified, "boolean")(text_or_empty(text_col)))
