"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over character n-grams and words is trained on confirmed toxic texts (P) and a
sample of unlabelled texts (U). With class prior pi, the risk of a decision function is estimated as

    pi * R_P(+)  +  max(0, R_U(-) - pi * R_P(-))

so the negative part is corrected for the toxic texts inside U and is never driven below zero: when a
step would make it negative, the step goes up that term's gradient instead (Kiryo et al., 2017).

The fit uses a bounded sample of texts of all lengths, its size a parameter; the class prior counts all labelled training
rows. Scoring is one pass over whole texts: a word's features are looked up once for each worker.

Defined cases: a null or empty text scores the classifier's bias; without a toxic training row or any
text the score is the class prior (0 without labels); rows that repeat an id are scored apart, null ids too and
never held out; labels
that are null or belong to no document are ignored; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the fit: texts of either kind, the length to which longer ones are cut, features; and the fold that labels are never learned from.
POSITIVES, UNLABELLED, MAX_CHARS, FEATURES = 1_500, 3_000, 20_000, 4_096
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Words whose features a worker remembers.
MAX_REMEMBERED = 300_000
NGRAMS = (4, 5)
#: Numbers of occurrences that are features of their own.
LEVELS = (1, 3)
#: What a feature has to show in the sample to be used.
MIN_POSTERIOR, MIN_Z = 0.3, 5.0


def word_features(word: str) -> set[str]:
    """The word itself and its character n-grams, the word's beginning marked by a space."""
    s = f" {word}"
    return {s[i : i + n] for n in NGRAMS for i in range(len(s) - n + 1)} | {f"{word} "}


def text_features(text: str) -> set[str]:
    """Of every word and n-gram, which of the LEVELS its number of occurrences reaches: the level's digit before it."""
    counts: Counter[str] = Counter()
    for word, n in Counter(text.lower().split()).items():
        for f in word_features(word):
            counts[f] += n
    return {f"{level}{f}" for f, n in counts.items() for level in LEVELS if n >= level}


class LinearModel:
    """Weights of named features, and a bias; ``score`` is the probability of the toxic class."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._index = {f: i for i, f in enumerate(dict.fromkeys(f[1:] for f in weights))}
        self._values = [[weights.get(f"{level}{f}", 0.0) for level in LEVELS] for f in self._index]
        self._known: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        found = self._known.get(word)
        if found is None:
            found = tuple(sorted(self._index[f] for f in word_features(word) if f in self._index))
            if len(self._known) < MAX_REMEMBERED:
                self._known[word] = found
        return found

    def score(self, text: str) -> float:
        """The whole text's words, counted; a feature adds its weight for each level that it reaches."""
        hits: Counter[int] = Counter()
        words = text.lower().split()
        for found in map(self._word, words):
            if found:
                hits.update(found)
        return float(sigmoid(self.bias + sum(w for i, n in sorted(hits.items()) for level, w in zip(LEVELS, self._values[i], strict=True) if n >= level)))

    def __getstate__(self) -> tuple:
        return self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def choose_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], known: int, prior: float, most: int = FEATURES) -> np.ndarray:
    """Of features numbered below ``known``, those that make a text likely to be toxic: pi * P(f | toxic) / P(f) is at
    least MIN_POSTERIOR and the two rates differ by MIN_Z standard errors; the largest differences first."""
    n, m = len(positive), len(unlabelled)
    a, b = np.bincount(np.concatenate(positive), minlength=known) / n, np.bincount(np.concatenate(unlabelled), minlength=known) / m
    pooled = (a * n + b * m + 0.5) / (n + m + 1)
    z = (a - b) / np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    order = np.argsort(-z, kind="stable")[:most]
    return order[(z[order] >= MIN_Z) & (prior * a[order] >= MIN_POSTERIOR * b[order])]


def fit_texts(positive: list[str], unlabelled: list[str], prior: float) -> LinearModel:
    """Features that three positive texts have or more are numbered; a text is held as its numbers only."""
    counts: Counter[str] = Counter()
    for t in positive:
        counts.update(text_features(t))
    index = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= 3))}
    del counts

    def numbers(text: str) -> np.ndarray:
        return np.fromiter((index[f] for f in text_features(text) if f in index), np.int32)

    return fit_nnpu([numbers(t) for t in positive], [numbers(t) for t in unlabelled], list(index), prior)


def risk(w: np.ndarray, positive: tuple, unlabelled: tuple, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The negative part R_U(-) - pi R_P(-) of the risk, its positive part pi R_P(+), and the gradients of the latter and
    the former. Texts are given as feature numbers, the rows they belong to, and how many rows there are; the last weight is the bias."""
    k = len(w) - 1

    def scores(col: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, w[col], n) + w[k]

    def gradient(texts: tuple, each: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(texts[0], each[texts[1]], k), each.sum())

    zp, zu, n, m = scores(*positive), scores(*unlabelled), positive[2], unlabelled[2]
    # the logistic loss is log(1 + exp(-z)) for the label +, log(1 + exp(z)) for the label -
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g_negative = gradient(unlabelled, sigmoid(zu) / m) - prior * gradient(positive, sigmoid(zp) / n)
    return negative, prior * np.logaddexp(0, -zp).mean(), prior * gradient(positive, (sigmoid(zp) - 1) / n), g_negative


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], features: list[str], prior: float, steps: int = 1_000, rate: float = 0.02, l2: float = 1e-3) -> LinearModel:
    """Full-batch Adam on the non-negative risk with the logistic loss. A text is the numbers of its features."""
    chosen = choose_features(positive, unlabelled, len(features), prior)
    names = [features[i] for i in chosen]
    place = np.full(len(features) + 1, -1)
    place[chosen] = np.arange(len(chosen))

    def rows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        col, row = place[np.concatenate(texts)], np.repeat(np.arange(len(texts)), list(map(len, texts)))
        return col[col >= 0], row[col >= 0]

    p_col, p_row = rows(positive)
    u_col, u_row = rows(unlabelled)
    n, m, k = len(positive), len(unlabelled), len(names)
    w = np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior))
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        negative, _, g_positive, g_negative = risk(w, (p_col, p_row, n), (u_col, u_row, m), prior)
        g = g_positive + g_negative if negative >= 0 else -g_negative
        g[:k] += l2 * w[:k]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w[k] = min(w[k], np.log(prior / (1 - prior)))  # a text of no toxic feature is never likelier toxic than any text
    return LinearModel(dict(zip(names, w[:k].tolist(), strict=True)), float(w[k]))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> LinearModel:
    """Fit on samples of the training fold. A sample takes the ids whose hashes are least, as many as its bound allows."""
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(common.id_remainder("doc_id", FOLDS) != HELD_OUT)
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    prior = toxic / n if n else 0.0
    if not 0 < prior < 1:
        return LinearModel({}, 40.0 if prior == 1 else -40.0)
    draw = F.xxhash64("doc_id")
    usable = (F.length("text") > 0) & F.col("doc_id").isNotNull() & (common.id_remainder("doc_id", FOLDS) != HELD_OUT)
    texts = common.texts(docs).where(usable).withColumn("text", F.substring("text", 1, MAX_CHARS))
    ids = known.where("toxic = 1").select("doc_id").distinct().orderBy(draw, "doc_id").limit(2 * positives)
    chosen = texts.join(F.broadcast(ids), "doc_id", "left_semi")  # at most 2 * positives ids
    p = [r.text for r in chosen.orderBy(draw, "doc_id").limit(positives).collect()]
    u_rows = texts.select("doc_id").count()
    share = min(1.0, 1.5 * unlabelled / max(u_rows, 1))
    u_docs = texts.where(F.pmod(draw, F.lit(1 << 40)) < int(share * (1 << 40)) + 1).limit(3 * unlabelled)
    u = [r.text for r in u_docs.orderBy(draw, "doc_id").limit(unlabelled).collect()]
    if not p or not u:
        return LinearModel({}, float(np.log(prior / (1 - prior))))
    return fit_texts(p, u, prior)


def scored(docs: DataFrame, model: LinearModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            scores = [model.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(scores, pa.float64())})

    out = common.texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(common.id_remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: LinearModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores below the threshold."""
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            yield b.filter(pa.array([model.score(t or "") < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
