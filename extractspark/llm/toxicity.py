"""Toxicity by a classifier chain.

Categories are predicted one after the other; the model of a category is a logistic regression over word features and
the probabilities of the categories before it. While training, those probabilities come from models that have not seen
the row (folds), so later models learn from what they will get. Features are words and their beginnings of three to
eight letters; those that tell the classes apart best on the labelled sample are kept.

The sample has at most ``sample`` labelled documents of each class, chosen by a hash of doc_id; that is the one bound.
Every document is scored whole. The labels name one category, ``toxic``; the narrower ones before it are kinds of toxic
documents, found in the sample itself: clusters of the toxic rows by their features (spherical k-means from the farthest
rows). A row's kind is that of the nearest centre among those that were fitted without the row's fold, so that no label is
made from a clustering that has seen the row. No word is given beforehand.

Defined results: a null or empty text has no features and gets the prior's probability, which is not toxic; a text of any
length is read whole, in one task; without labelled rows of both classes every probability is 0; a probability of exactly
the threshold is toxic; labels of one doc_id that differ count as toxic, and of texts with one doc_id the least is learned
from; repeated rows are scored each for itself; a null doc_id stays null; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship
from .common import column, lean, scratch, slices, written

WORD = re.compile(r"[^\W\d_]+")
#: Words whose features a worker remembers.
REMEMBERED = 200_000
#: Kinds of toxic documents that come before toxic itself.
KINDS = 4


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    """The word, and its beginnings with a mark."""
    return [word, *("^" + word[:k] for k in range(3, 9) if len(word) >= k)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 7) -> np.ndarray:
    """Weights, the last one the intercept, by Newton's steps on the ridge-penalised likelihood."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (p - y) + penalty * w
        curve = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centres(x: np.ndarray, k: int, steps: int = 20) -> np.ndarray:
    """Unit centres of k clusters of unit rows, from the row nearest to the mean and then the farthest from those before."""
    if not len(x):
        return np.zeros((k, x.shape[1]))
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < k:
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    middle = x[chosen]
    for _ in range(steps):
        nearest = (x @ middle.T).argmax(axis=1)
        new = _unit(np.array([x[nearest == c].sum(axis=0) if (nearest == c).any() else middle[c] for c in range(k)]))
        if np.allclose(new, middle):
            break
        middle = new
    return middle


def kinds_of(x: np.ndarray, toxic: np.ndarray, fold: np.ndarray, k: int = KINDS) -> np.ndarray:
    """For each row and kind whether the row is toxic and of that kind, by centres that were fitted without its fold."""
    out, bad = np.zeros((len(x), k)), toxic > 0
    unit = _unit(x)
    whole = centres(unit[bad], k)
    for f in range(int(fold.max()) + 1 if len(fold) else 0):
        held = np.flatnonzero((fold == f) & bad)
        rest = bad & (fold != f)
        if not len(held):
            continue
        # The fold's centres take the names of those of the whole sample, the most alike first.
        own = centres(unit[rest], k) if rest.any() else whole
        alike, name = own @ whole.T, np.zeros(k, int)
        for _ in range(k):
            a, b = np.unravel_index(np.argmax(alike), alike.shape)
            name[a], alike[a, :], alike[:, b] = b, -2.0, -2.0
        out[held, name[(unit[held] @ own.T).argmax(axis=1)]] = 1.0
    return out


class Chain:
    """The fitted models, category by category."""

    def __init__(self, vocabulary: list[str], categories: list[str]) -> None:
        self.at = {w: i for i, w in enumerate(vocabulary)}
        self.categories = categories
        self.weights: list[np.ndarray] = []
        self.known: dict[str, list[int]] = {}

    def matrix(self, sets: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(sets), len(self.at)))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for i, words in enumerate(sets):
            for w in words:
                hits = known.get(w)
                if hits is None:
                    hits = known[w] = [self.at[f] for f in features(w) if f in self.at]
                if hits:
                    x[i, hits] = 1
        return x

    def fit(self, x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Fits all models; returns the out-of-fold probabilities, a column for each category."""
        folds = int(fold.max()) + 1 if len(fold) else 0
        for c in range(len(self.categories)):
            y, unseen = labels[:, c], np.zeros(len(x))
            for k in range(folds):
                held = fold == k
                if held.any() and not held.all():
                    unseen[held] = probability(x[held], logistic(x[~held], y[~held]))
            self.weights.append(logistic(x, y))
            x = np.hstack([x, unseen[:, None]])
        return x[:, -len(self.categories) :]

    def predict(self, x: np.ndarray) -> np.ndarray:
        for w in self.weights:
            x = np.hstack([x, probability(x, w)[:, None]])
        return x[:, len(self.at) :]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, size: int = 256, folds: int = 3, kinds: int = KINDS) -> Chain:
    """Train on at most 2 * sample labelled documents, whatever the number of labels."""
    with scratch(docs.sparkSession):
        return _fit(docs, labels, sample, size, folds, kinds)


def _fit(docs: DataFrame, labels: DataFrame, sample: int, size: int, folds: int, kinds: int) -> Chain:
    ship(docs.sparkSession)
    categories = [*(f"kind_{i + 1}" for i in range(kinds)), "toxic"]
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for value in (0, 1)]
    # The sample's ids: at most 2 * sample rows of two numbers.
    picked = F.broadcast(parts[0].unionByName(parts[1]))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sets = [sorted(words_of(t)) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "toxic"), pa.array(sets, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = written(own.select("doc_id", "text", "toxic").mapInArrow(lean(tokens), "doc_id long, toxic int, words array<string>"), "toxic-sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Chain([], categories)
    # Documents of either class that have the feature, and how sure it is that their shares differ.
    starts = [F.concat(F.lit("^"), F.substring("word", 1, k)) for k in range(3, 9)]
    each = F.array_compact(F.array("word", *[F.when(F.length("word") >= k, s) for k, s in enumerate(starts, 3)]))
    found = rows.select("doc_id", "toxic", F.explode("words").alias("word")).select("doc_id", "toxic", F.explode(each).alias("feature")).distinct()
    counted = found.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all")).where("all >= 4")
    share = F.col("all") / (n[0] + n[1])
    gap = F.abs(F.col("bad") / n[1] - (F.col("all") - F.col("bad")) / n[0]) / F.sqrt(share * (1 - share) + 1e-9)
    # Beginnings of the same words say the same: the shortest stands for all.
    alike = Window.partitionBy("bad", "all", F.substring(F.regexp_replace("feature", r"^\^", ""), 1, 3)).orderBy(F.length("feature"), "feature")
    counted = counted.withColumn("nth", F.row_number().over(alike)).where("nth = 1")
    vocabulary = [r["feature"] for r in counted.orderBy(gap.desc(), "feature").limit(size).collect()]
    chain = Chain(vocabulary, categories)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [set(x) for x in column(batch, "words").to_pylist()]
            hits = [np.flatnonzero(r).tolist() for r in chain.matrix(sets)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "toxic"), pa.array(hits, pa.list_(pa.int32()))], names=["doc_id", "toxic", "hits"])

    sampled = sorted(rows.mapInArrow(lean(told), "doc_id long, toxic int, hits array<int>").collect(), key=lambda r: r["doc_id"])
    x = np.zeros((len(sampled), len(vocabulary)))
    for i, r in enumerate(sampled):
        x[i, r["hits"]] = 1
    toxic, fold = np.array([float(r["toxic"]) for r in sampled]), np.arange(len(sampled)) % folds
    chain.fit(x, np.hstack([kinds_of(x, toxic, fold, kinds), toxic[:, None]]), fold)
    return chain


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, a probability for each category, and whether the last one reaches the threshold."""
    ship(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            texts = column(batch, "text").to_pylist()
            p = chain.predict(chain.matrix([words_of(t) for t in texts])) if chain.weights else np.zeros((len(texts), len(names)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(np.round(p[:, c], 6)) for c in range(len(names))), pa.array(p[:, -1] >= threshold)], names=["doc_id", *names, "is_toxic"])

    schema = "doc_id long, " + "".join(f"{n} double, " for n in names) + "is_toxic boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), schema)
