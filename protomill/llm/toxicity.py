"""Toxicity: a linear classifier of words with a counterfactual penalty on identity terms.

A word's value is the sum of the learned weights of its features: the word in lower case and its beginnings of three to six characters.
A text is read in windows of ``WINDOW`` words that overlap by half and cover it whole; a window's logit is the bias and the
sum of its distinct words' values, and the text's is that of its worst window, so that a toxic passage counts wherever it stands.

Fitting.  At most ``sample_docs`` labelled documents (those with the smallest hashes of their ids) are read whole.  Each document is first
represented by one window, then, in each of the later rounds, by its worst window so far, as in scoring.

Counterfactuals.  The sentences of the labelled documents are paired with copies in which an identity term (``IDENTITY_TERMS``) is swapped for
each other term of its group and for a neutral word; a sentence without one gets a neutral word added and, in its copy, a term in its place.  The squared change of the sentence's logit
is added to the loss, so a mention of a group moves no score: neither a term that stands often in toxic texts, nor one that begins as
an insult does.  The weight of the penalty is ``counterfactual``; 0 leaves it out.

Null and empty texts, and texts without words, have the bias alone.  A score depends on nothing but the text: rows that repeat have equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import cycle, islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protomill.llm.common import map_texts

#: Words of a window.
WINDOW = 256
#: Weights; features are dealt to them by hash.
BUCKETS = 1 << 18
#: Lengths of the beginnings of a word that are features.
BEGINNINGS = (3, 4, 5, 6)
#: Deviations in standard errors at which a feature counts half.
DOUBT = 5.0
#: Words that one Python worker remembers the values of; then it starts anew.
MEMORY_WORDS = 500_000
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")

# Identity terms by group; a term is swapped for others of its group.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "women and men": ("women", "men", "woman", "man", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    "religion": ("christian", "muslim", "jewish", "hindu", "buddhist", "mormon", "sikh", "atheist", "catholic", "christen", "muslime", "juden", "chrétiens", "musulmans", "juifs", "cristianos", "musulmanes", "judíos"),
    "origin": (
        "african", "american", "arab", "asian", "chinese", "european", "french", "german", "indian", "mexican", "moroccan", "polish", "russian", "spanish", "turkish",
        "immigrants", "refugees", "einwanderer", "immigrés", "inmigrantes",
    ),
    "colour": ("black", "white", "brown", "schwarze", "weiße", "noirs", "blancs", "negros", "blancos"),
    "orientation": ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "schwule", "lesben", "lesbiennes", "lesbianas"),
    "ability and age": ("deaf", "blind", "disabled", "autistic", "old", "young", "elderly", "behinderte", "handicapés", "discapacitados"),
}
# Words for anyone at all.
NEUTRAL_WORDS = ("people", "persons", "menschen", "personnes", "personas")


def features(word: str) -> list[int]:
    """Numbers of a lower-case word's features."""
    names = ["=" + word, *[word[:n] for n in BEGINNINGS if n < len(word)]]
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def starts_of(words: int) -> range:
    """First words of the windows of a text: each begins half a window behind the last, until one reaches the end."""
    return range(0, max(1, words - WINDOW // 2), WINDOW // 2)


@dataclass
class Model:
    weights: np.ndarray
    bias: float


class Values(dict):
    """Values of words; they are computed once."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        found = self[word] = sum(map(self.weights.__getitem__, features(word)))
        return found


class Scorer:
    """Scores texts, and remembers the values of words."""

    def __init__(self, model: Model):
        self.values, self.bias = Values(model.weights), model.bias

    def logit(self, text: str) -> float:
        words, value = words_of(text), self.values.__getitem__
        # a window is two neighbouring halves; words that stand in both count once
        halves = [dict.fromkeys(words[at : at + WINDOW // 2]) for at in range(0, len(words), WINDOW // 2)] or [{}]
        sums = [sum(map(value, h)) for h in halves]
        both = [sums[i] + sums[i + 1] - sum(value(w) for w in halves[i + 1] if w in halves[i]) for i in range(len(halves) - 1)]
        if len(self.values) > MEMORY_WORDS:
            self.values.clear()
        return self.bias + max(both or sums)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -30, 30))))


class Vocabulary:
    """The words of labelled texts, numbered, with the features of each."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.lists: list[list[int]] = []

    def of(self, word: str) -> int:
        found = self.number.get(word)
        if found is None:
            found = self.number[word] = len(self.lists)
            self.lists.append(features(word))
        return found


def counterfactuals(texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Pairs of words (as numbers) that a sentence and its copy differ in, one row for each copy."""
    group_of = {t: terms for terms in IDENTITY_TERMS.values() for t in terms}
    added = cycle([(vocabulary.of(t), vocabulary.of(n)) for n in NEUTRAL_WORDS for t in group_of])
    pairs = []
    for text in texts:
        sentences = _SENTENCE.findall(text.lower())
        if group_of.keys().isdisjoint(words_of(text)):
            pairs += islice(added, len(sentences))
            continue
        for sentence in sentences:
            named = [w for w in words_of(sentence) if w in group_of]
            for w in named:
                pairs += [(vocabulary.of(w), vocabulary.of(t)) for t in (*group_of[w], *NEUTRAL_WORDS) if t != w]
            if not named:
                pairs.append(next(added))
    return np.array(pairs, dtype=np.int64).reshape(-1, 2)


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """The limited-memory BFGS method with a halving line search."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, parts = slope.copy(), []
        for s, y, r in reversed(past):
            parts.append(r * (s @ way))
            way -= parts[-1] * y
        if past:
            way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y, r), a in zip(past, reversed(parts), strict=True):
            way += (a - r * (y @ way)) * s
        pace, fall = 1.0, slope @ way
        if not past:
            pace = 1 / max(1.0, float(np.sqrt(fall)))
        while True:
            new = x - pace * way
            new_value, new_slope = f(new)
            if new_value <= value - 1e-4 * pace * fall or pace < 1e-6:
                break
            pace /= 2
        if pace < 1e-6 or value - new_value < 1e-7:
            return new if new_value < value else x
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1 / (s @ y))]
        x, value, slope = new, new_value, new_slope
    return x


def fit(texts: list[str], labels: np.ndarray, counterfactual: float = 1.0, rounds: int = 3, steps: int = 60, decay: float = 1e-4, fewest: int = 2) -> Model:
    """Minimises the mean logistic loss of the documents' windows, with the counterfactual penalty and half of ``decay`` times the squared weights.

    A feature is scaled by how clearly the documents that hold it differ in their labels from all (z**2 / (z**2 + DOUBT**2), with z the deviation in standard errors),
    so that thousands of features that mean nothing don't add up to something; whole identity terms and neutral words are not scaled.  Features that fewer than ``fewest``
    documents hold are left out.  Deterministic for a given order.
    """
    nothing = Model(np.zeros(BUCKETS, np.float32), 0.0)
    if not len(texts):
        return nothing
    vocabulary = Vocabulary()
    documents = [np.array([vocabulary.of(w) for w in words_of(t)], dtype=np.int64) for t in texts]
    pairs = counterfactuals(texts, vocabulary) if counterfactual else np.zeros((0, 2), np.int64)
    target, n = np.asarray(labels, dtype=np.float64), len(texts)
    held, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for words, label in zip(documents, target, strict=True):
        mine = np.unique([f for w in np.unique(words).tolist() for f in vocabulary.lists[w]]).astype(np.int64)
        held[mine] += 1
        toxic[mine] += label
    rate = target.mean()
    squared = (toxic - held * rate) ** 2 / np.maximum(held * rate * (1 - rate), 1e-9)
    clear = np.where(held >= fewest, squared / (squared + DOUBT**2), 0.0)
    clear[[features(t)[0] for terms in (*IDENTITY_TERMS.values(), NEUTRAL_WORDS) for t in terms]] = 1.0
    used = np.nonzero(clear)[0]
    scale = np.append(clear[used], 0.0)
    place = np.full(BUCKETS, len(used))  # features that are left out share the last weight
    place[used] = np.arange(len(used))
    flat = place[np.concatenate([np.array(x) for x in vocabulary.lists])] if vocabulary.lists else np.zeros(0, np.int64)
    lengths = np.array([len(x) for x in vocabulary.lists], dtype=np.int64)
    owner, begin = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
    windows = [[np.unique(words[at : at + WINDOW]) for at in starts_of(len(words))] for words in documents]
    x, values = np.zeros(len(used) + 2), np.zeros(len(lengths))  # weights, that of features left out, bias
    for turn in range(rounds):
        worst = [w[max(range(len(w)), key=lambda k: values[w[k]].sum())] if turn else w[i % len(w)] for i, w in enumerate(windows)]
        tokens, owners = np.concatenate(worst), np.repeat(np.arange(n), [len(w) for w in worst])

        def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
            each = np.add.reduceat((scale * x[:-1])[flat], begin) if len(flat) else np.zeros(0)
            logit = x[-1] + np.bincount(owners, weights=each[tokens], minlength=n)
            total = (np.logaddexp(0, logit) - target * logit).mean() + decay / 2 * (x[:-1] @ x[:-1])
            delta = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - target) / n
            slope = np.bincount(tokens, weights=delta[owners], minlength=len(lengths))
            if len(pairs):
                change = each[pairs[:, 0]] - each[pairs[:, 1]]
                total += counterfactual * (change @ change) / len(pairs)
                change *= 2 * counterfactual / len(pairs)
                slope += np.bincount(pairs[:, 0], weights=change, minlength=len(lengths)) - np.bincount(pairs[:, 1], weights=change, minlength=len(lengths))
            return total, np.append(scale * np.bincount(flat, weights=slope[owner], minlength=len(scale)) + decay * x[:-1], delta.sum())

        x = minimise(loss, x, steps)
        values = np.add.reduceat((scale * x[:-1])[flat], begin) if len(flat) else values
    nothing.weights[used] = scale[:-1] * x[:-2]
    return Model(nothing.weights, float(x[-1]))


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, counterfactual: float = 1.0) -> Model:
    """Fits a model on at most ``sample_docs`` labelled documents outside the held-out part (a documented bound; scoring covers every text).

    Labels other than 0 and 1, and null ids or labels, are left out.  Of rows that repeat, each counts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_docs)  # the documented bound
    text = F.coalesce(F.col("text"), F.lit("")).alias("__text")
    rows = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "__text").limit(sample_docs).collect()
    return fit([r["__text"] for r in rows], np.array([r["toxic"] for r in rows]), counterfactual)


def score(df: DataFrame, model: Model, keep: list[str], text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``keep`` and score and predicted of every whole text; narrow, no shuffle."""
    at = np.nonzero(model.weights)[0].astype(np.int32)  # the features that were met, a megabyte at most
    packed = (at, model.weights[at], model.bias)

    def make() -> Callable[[list[str]], list[list]]:
        where, values, bias = packed
        weights = np.zeros(BUCKETS, np.float32)
        weights[where] = values
        own = Scorer(Model(weights, bias))

        def work(texts: list[str]) -> list[list]:
            found = [own.score(t) for t in texts]
            return [found, [int(x >= threshold) for x in found]]

        return work

    return map_texts(df, keep, text_col, "score double, predicted int", make)
