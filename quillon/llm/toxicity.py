"""Toxicity by a classifier chain.

Categories are label columns in a fixed order. A category's model is a logistic
regression over selected word and word-beginning features plus the earlier
categories' probabilities; those probabilities are out-of-fold when a model is
trained, so a later model sees the errors that it will meet. Training takes at most
``max_labelled`` labelled rows (lowest hash of the id first, a documented bound), whose
features executors find: the driver gets their 64-bit hashes, never a text. Scoring
covers every row and whole texts.

Defined results: a null or empty text has no features and gets the chain's base
rates; rows without a label are scored, not trained on; a null label leaves the row
out of training; without any usable label every probability is 0; repeated rows are
scored each. A repeated id joins each of its labels; the bound holds for the joined rows too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quillon.llm.shared import bounded_batches, byte_texts, release, tidy

#: Everything of ASCII that is not a letter or digit separates; A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
PREFIXES = (4, 5, 6)


def text_words(text: bytes) -> set[bytes]:
    return set(text.translate(_TABLE).split())


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashes of the word, and of its first 4, 5 and 6 characters where it is longer: insults
    appear inflected, as stems of otherwise unseen words."""
    s = word.decode("utf-8", "replace")
    return tuple(xxhash.xxh3_64_intdigest(f) for f in [b"w" + word] + [b"p" + s[:k].encode() for k in PREFIXES if len(s) > k])


@dataclass
class Chain:
    categories: list[str]
    features: list[dict[int, int]] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)  # features, earlier categories, bias

    def predict(self, docs: list[set[int]]) -> np.ndarray:
        out = np.zeros((len(docs), len(self.categories)))
        for k, (index, w) in enumerate(zip(self.features, self.weights, strict=True)):
            z = np.full(len(docs), w[-1])
            for i, found in enumerate(docs):
                hit = {index[f] for f in found if f in index}
                z[i] += sum(w[j] for j in sorted(hit))
            z += out[:, :k] @ w[len(index) : len(index) + k]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def _select(docs: list[np.ndarray], y: np.ndarray, names: np.ndarray, count: int, least: int) -> dict[int, int]:
    """The ``count`` features with the largest chi-square against the label, among those in ``least`` rows."""
    if not len(docs):
        return {}
    size = len(names)
    a1 = np.bincount(np.concatenate([d for d, t in zip(docs, y, strict=True) if t] or [np.zeros(0, np.int32)]), minlength=size).astype(float)
    a0 = np.bincount(np.concatenate([d for d, t in zip(docs, y, strict=True) if not t] or [np.zeros(0, np.int32)]), minlength=size).astype(float)
    n1, n0, a = float(y.sum()), float(len(y) - y.sum()), a0 + a1
    chi = (a1 * (n0 - a0) - a0 * (n1 - a1)) ** 2 * (n0 + n1) / np.maximum(1.0, a * (n0 + n1 - a) * n0 * n1)
    good = np.flatnonzero((a >= least) & (chi > 6.6))
    best = good[np.lexsort((names[good], -chi[good]))][:count]
    return {int(j): i for i, j in enumerate(best)}


def _fit(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 15) -> np.ndarray:
    """Logistic regression by Newton steps; the last column of x is the bias, not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + shrink * w
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(shrink)
        d = np.linalg.solve(h, g)
        d *= min(1.0, 5 / max(1e-9, np.abs(d).max()))
        w -= d
        if np.abs(d).max() < 1e-4:
            break
    return w


def _matrix(docs: list[np.ndarray], index: dict[int, int], earlier: np.ndarray) -> np.ndarray:
    x = np.zeros((len(docs), len(index) + earlier.shape[1] + 1))
    for i, found in enumerate(docs):
        for f in found.tolist():
            j = index.get(f)
            if j is not None:
                x[i, j] = 1
    x[:, len(index) : -1] = earlier
    x[:, -1] = 1
    return x


def fit_chain(
    docs: list[np.ndarray], names: np.ndarray, labels: np.ndarray, categories: list[str], folds: int = 4, count: int = 256, least: int = 5, l2: float = 0.5
) -> Chain:
    """``docs`` hold distinct places in ``names``, in a fixed order; fold i takes every ``folds``-th row."""
    chain, fold = Chain(list(categories)), np.arange(len(docs)) % folds
    out_of_fold = np.zeros(labels.shape)
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        index = _select(docs, y, names, count, least)
        for part in range(folds if k + 1 < len(categories) else 0):  # the last category feeds no other
            held = fold == part
            if held.any() and not held.all():
                own = _select([d for d, h in zip(docs, held, strict=True) if not h], y[~held], names, count, least)
                x = _matrix(docs, own, out_of_fold[:, :k])
                out_of_fold[held, k] = 1 / (1 + np.exp(-np.clip(x[held] @ _fit(x[~held], y[~held], l2), -40, 40)))
        chain.features.append({int(names[j]): i for j, i in index.items()})
        chain.weights.append(_fit(_matrix(docs, index, out_of_fold[:, :k]), y, l2) if len(docs) else np.array([0.0] * k + [-40.0]))
    return chain


#: Parts that labelled rows come to the driver in, and ranges of hashes that it counts in.
PARTS = 16


def _in_several(hashes: list[np.ndarray], least: int) -> np.ndarray:
    """The hashes in ``least`` of the sorted arrays, in order; what is put together at once is a range of them."""
    edges = np.array([(k << 64) // PARTS for k in range(1, PARTS)], np.uint64)
    cuts = [[0, *np.searchsorted(h, edges).tolist(), len(h)] for h in hashes]
    names = [np.zeros(0, np.uint64)]
    for k in range(PARTS):
        found, rows = np.unique(np.concatenate([names[0], *[h[c[k] : c[k + 1]] for h, c in zip(hashes, cuts, strict=True)]]), return_counts=True)
        names.append(found[rows >= least])
    return np.concatenate(names)


def train(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 8000, least: int = 5
) -> Chain:
    """``targets``: (category, SQL condition over the label columns), in chain order."""
    bounded_batches(spark)
    ys = [f"_y{k}" for k in range(len(targets))]
    picked = labels.select(F.col(id_col).alias("_id"), *[F.expr(cond).cast("int").alias(y) for y, (_, cond) in zip(ys, targets, strict=True)]).dropna()
    picked = picked.orderBy(F.xxhash64("_id"), "_id", *ys).limit(max_labelled)  # a bounded table
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(picked), "_id").select("_id", *ys, F.xxhash64("_text").alias("_t"), feature_hashes("_text").alias("_f"))
    joined = joined.orderBy(F.xxhash64("_id"), "_id", *ys, "_t").limit(max_labelled)  # ids may repeat in the documents
    found = sorted((r[0], tuple(r[1:-2]), r[-1]) for r in joined.repartition(PARTS).toLocalIterator())  # a part at a time
    hashes = [np.frombuffer(f, np.uint64) for _, _, f in found]
    names = _in_several(hashes, least)  # rarer ones are never selected
    places = []
    for h in hashes:
        at = np.searchsorted(names, h)
        places.append(at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == h)].astype(np.int32) if len(names) else at[:0].astype(np.int32))
    ys_found = np.array([y for _, y, _ in found], float).reshape(len(found), len(targets))
    del found, hashes
    chain = fit_chain(places, names, ys_found, [c for c, _ in targets], least=least)
    del places, names
    release()
    return chain


class Remembered:
    """Features of the words that a task has met, at most about ``most`` bytes of them."""

    def __init__(self, features, most: int = 16 << 20):
        self.features, self.most, self.words, self.size = features, most, {}, 0

    def of(self, text: bytes) -> set[int]:
        hits: set[int] = set()
        words = self.words
        for w in text_words(text):
            fs = words.get(w)
            if fs is None:
                fs = self.features(w)
                self.size += 200 + len(w) + 40 * len(fs)  # an entry, its word, the numbers
                if self.size > self.most:
                    words.clear()
                    self.size = 0
                words[w] = fs
            if fs:
                hits.update(fs)
        return hits


@F.arrow_udf(BinaryType())
@tidy
def feature_hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A text's distinct features, as sorted 64-bit hashes."""
    known = Remembered(word_features)
    for texts in batches:
        out = []
        for k in range(0, len(texts), 256):
            for t in byte_texts(texts.slice(k, 256)):
                hits = known.of(t)
                out.append(np.sort(np.fromiter(hits, np.uint64, len(hits))).tobytes())
        yield pa.array(out, pa.binary())


def probabilities(spark: SparkSession, chain: Chain, text: Column | str = "text") -> Column:
    """A column with one probability for each category, in chain order."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(chain)

    @F.arrow_udf("array<double>")
    @tidy
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        wanted = set().union(*model.features) if model.features else set()
        known = Remembered(lambda w: tuple(f for f in word_features(w) if f in wanted))
        for texts in batches:
            out: list[list[float]] = []
            for k in range(0, len(texts), 256):
                out += model.predict([known.of(t) for t in byte_texts(texts.slice(k, 256))]).tolist()
            yield pa.array(out, pa.list_(pa.float64()))

    return score(text)


#: Chain order of the corpus tables: low quality first, then toxic.
TARGETS = [("low_quality", "quality = 0"), ("toxic", "toxic = 1")]


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and the decision for every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = train(spark, docs, labels, TARGETS)
    p = docs.select("doc_id", probabilities(spark, chain, "text").alias("p"))
    return p.select("doc_id", F.col("p")[0].alias("p_low_quality"), F.col("p")[1].alias("p_toxic"), (F.col("p")[1] >= 0.5).alias("toxic"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a toxic probability of 0.5 or more go."""
    chain = train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS)
    return docs.where(probabilities(spark, chain, F.col("text"))[1] < 0.5)
