"""Toxicity categories by a chain of linear classifiers.

``CHAIN`` names the categories in order. Each one's logistic regression sees the text's words and
the probabilities of all earlier categories. Those come, for training, from models that were
fitted without the text's fold, so a later model learns how far the earlier ones can be trusted; for
scoring, from the models fitted on all training texts. A category's threshold is the cut with the best
F1 score over the same out-of-fold probabilities.

Words are hashed to ``BITS`` bits; a text is the set of its words. A word's column holds how much more
often, as a log ratio, texts of the category have it; rare words are drawn to 0. The models are fitted on a bounded sample: the ``SAMPLE``
labelled rows with the smallest hashes of their doc_id. Their words are counted by Spark tasks; only
hashed numbers come to the driver, a few MB. Scoring is a map over all documents.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, slices, table

#: Category and the SQL of its label over the columns of labels, in the order of the chain.
CHAIN = {
    "low_quality": "quality = 0",
    "toxic": "toxic = 1",
    "toxic_low_quality": "toxic = 1 AND quality = 0",
}
BITS = 18
FOLDS = 3
SAMPLE = 6000
#: Texts that a word's ratio is smoothed with, and the least ratio of a word with a weight.
SMOOTH = 10.0
LEAST_RATIO = 1.0
STEPS = 400
RIDGE = 1e-5
KEPT_WORDS = 100_000
#: Texts looked at together.
ROWS = 500
#: A-Z in lower case; ASCII characters that are no letters or digits part words.
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


class Hashed(dict):
    """The number of each word, looked up once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = xxhash.xxh64_intdigest(word) >> (64 - BITS)
        return n

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct numbers of a text's words."""
        if len(self) > KEPT_WORDS:
            self.clear()
        words = set((text or "").encode().translate(PLAIN).split())
        return np.unique(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))


class Texts(NamedTuple):
    """Texts as rows of a sparse matrix, with the chain's probabilities as more columns."""

    words: np.ndarray
    rows: np.ndarray
    n: int

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Texts:
        lens = [len(s) for s in sets]
        words = np.concatenate([*sets, np.empty(0, np.int32)]).astype(np.int64)
        return cls(words, np.repeat(np.arange(len(sets)), lens), len(sets))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def ratios(texts: Texts, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Log ratio of each word's share of the category's texts to its share of the others."""
    at, n = use[texts.rows], max(1, int(use.sum()))
    out = np.zeros(1 << BITS)
    for sign, of in ((1, y > 0), (-1, y == 0)):
        size = int((use & of).sum())
        held = np.bincount(texts.words[at & of[texts.rows]], minlength=1 << BITS)
        out += sign * np.log((held + SMOOTH * max(size, 1) / n) / (size + SMOOTH))
    held = np.bincount(texts.words[at], minlength=1 << BITS)
    return np.where((held > 0) & (np.abs(out) >= LEAST_RATIO), out, 0.0)


def fit_linear(texts: Texts, more: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on the rows ``use`` by accelerated gradient steps; weights of words, then of ``more``."""
    size, n = 1 << BITS, max(1, int(use.sum()))
    ratio = ratios(texts, y, use)
    at = use[texts.rows] & (ratio[texts.words] != 0)
    words, rows = texts.words[at], texts.rows[at]
    values = ratio[words]
    w, v, t = np.zeros(size + more.shape[1]), np.zeros(size + more.shape[1]), 1.0
    longest = (np.bincount(rows, values * values, minlength=texts.n) + (more**2).sum(axis=1)).max(initial=1)
    step = 4 / longest
    for _ in range(STEPS):
        p = sigmoid(np.bincount(rows, v[words] * values, minlength=texts.n) + more @ v[size:])
        wrong = np.where(use, p - y, 0) / n
        grad = np.concatenate([np.bincount(words, wrong[rows] * values, minlength=size), more.T @ wrong]) + RIDGE * v
        w, last = v - step * grad, w
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = w + (before - 1) / t * (w - last)
    return np.concatenate([w[:size] * ratio, w[size:]])


def linear(texts: Texts, more: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(np.bincount(texts.rows, w[texts.words], minlength=texts.n) + more @ w[1 << BITS :])


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the highest F1 score, halfway to the next lower probability; 0.5 without a positive text."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    if not len(p) or not hits[-1]:
        return 0.5
    ends = np.append(np.flatnonzero(np.diff(p)), len(p) - 1)  # the last of equal probabilities
    f1 = 2 * hits[ends] / (ends + 1 + hits[-1])
    k = ends[f1.argmax()]
    return float((p[k] + p[min(k + 1, len(p) - 1)]) / 2)


class Chain(NamedTuple):
    weights: list[np.ndarray]
    cuts: list[float]

    def predict(self, texts: Texts) -> np.ndarray:
        """Probabilities of the categories, a column each."""
        more = np.ones((texts.n, 1))
        for w in self.weights:
            more = np.column_stack([more, linear(texts, more, w)])
        return more[:, 1:]


def fit_chain(sets: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> Chain:
    """``y``: a column of 0 and 1 for each category; ``fold``: of each text."""
    texts = Texts.of(sets)
    more, every = np.ones((texts.n, 1)), np.ones(texts.n, bool)
    weights, cuts = [], []
    for k in range(y.shape[1]):
        weights.append(fit_linear(texts, more, y[:, k], every))
        out = np.zeros(texts.n)
        for f in range(FOLDS):
            out = np.where(fold == f, linear(texts, more, fit_linear(texts, more, y[:, k], fold != f)), out)
        cuts.append(best_cut(out, y[:, k]))
        more = np.column_stack([more, out])
    return Chain(weights, cuts)


def training_set(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, fold, a column for each category, words) of the sample; of repeated ids one row."""
    wanted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    wanted = wanted.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    wanted = wanted.select("doc_id", *(F.expr(sql).cast("int").alias(c) for c, sql in CHAIN.items()))
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    schema = "doc_id long, " + ", ".join(f"{c} int" for c in CHAIN) + ", words array<int>"

    def run(batches):
        hashed = Hashed()
        for b in slices(batches, ROWS):
            cols = {c: b[c] for c in ["doc_id", *CHAIN]}
            yield record_batch(cols | {"words": [hashed.of(t) for t in b["text"].to_pylist()]}, schema)

    found = texts.select(F.col("doc_id").cast("long"), *CHAIN, "text").mapInArrow(run, schema)
    return found.groupBy("doc_id").agg(*(F.min(c).alias(c) for c in [*CHAIN, "words"]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    rows = sorted(training_set(docs, labels, sample).collect())
    y = np.array([[r[c] for c in CHAIN] for r in rows], float).reshape(len(rows), len(CHAIN))
    fold = np.array([xxhash.xxh64_intdigest(str(r["doc_id"])) % FOLDS for r in rows], int)
    return fit_chain([np.array(r["words"], np.int32) for r in rows], y, fold)


RESULT = "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN) + ", toxic boolean"


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Each category's probability, and toxic: p_toxic reaches the category's cut.

    Takes (doc_id long, text string); other columns are ignored. A row for each input row, each by
    itself, so repeated rows get equal results. A null or empty text has no words: the
    intercepts alone speak. Long texts count whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(chain)  # 2 ** BITS numbers for each category, whatever the input

    def run(batches):
        hashed, model = Hashed(), shared.value
        cut = model.cuts[list(CHAIN).index("toxic")]
        for b in slices(batches, ROWS):
            p = model.predict(Texts.of([hashed.of(t) for t in b["text"].to_pylist()]))
            out = {f"p_{c}": p[:, k] for k, c in enumerate(CHAIN)}
            yield record_batch(out | {"doc_id": b["doc_id"].cast(pa.int64()), "toxic": out["p_toxic"] >= cut}, RESULT)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def without_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score`` doesn't call toxic.

    Each row is judged by itself: rows that repeat stay or go together. Null and empty texts, long ones and ids are as in
    ``score``; columns but text are not looked at. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        hashed, model = Hashed(), shared.value
        k = list(CHAIN).index("toxic")
        for b in slices(batches, ROWS):
            p = model.predict(Texts.of([hashed.of(t) for t in b["text"].to_pylist()]))
            yield b.filter(pa.array(p[:, k] < model.cuts[k]))

    return docs.mapInArrow(run, docs.schema)
