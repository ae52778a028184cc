"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or absent: words, pairs of words that follow one another, pairs with one word between
(skip-grams), the first STEMS bytes of words (abusive words come inflected and compounded, which whole words miss in
some languages), and for each of these whether it comes at least TIMES often. Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Features are hashed
to 2**BITS coordinates.

FTRL-proximal gives each coordinate its own rate and, by L1, an exact zero to those without clear evidence, so the
model is a few thousand weights at most times the evidence in the sample, bounded by 2**BITS, and is broadcast. It is
fitted on the TRAIN_ROWS labelled rows with the smallest hash of their doc_id (a bound). All tasks look for these rows
and write their features; one task then fits on that table, so the fit is the same work at any size. Every row is scored.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0. No other column than the text enters a
score.

Defined cases: a null or empty text has the score of the prior; a null doc_id counts as the empty text for the hash
(held out); several labels of a doc_id count as toxic if one is; of several texts of a labelled doc_id the one with the
smallest hash is learnt from; null labels are left out; without labels all scores
are the prior 1/20; repeated rows have equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docslice.runtime import arrow_rows, materialise, table

BITS = 20
STEMS = (3, 5, 7)
TIMES = (2, 4, 8)
TRAIN_ROWS = 8192
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.1
#: Each epoch takes the rows in an order of its own, drawn from this seed.
SEED = 11
FOLDS, HELD = 5, 0
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SHIFT = np.uint64(64 - BITS)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class Words:
    """Hashes of words and of their stems, kept for the words met last; with weights also which words bear any, by
    themselves, by a stem, or by a stem that comes often."""

    ROOM = 150_000

    def __init__(self, weights: np.ndarray | None = None):
        self.bears = None if weights is None else weights != 0
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.hashes = np.zeros((1 + len(STEMS), 1024), np.uint64)  # room for words, doubled as they come
        self.marked = np.zeros(1024, bool)

    def numbered(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, the columns of `hashes`."""
        if len(self.numbers) > self.ROOM:
            self._reset()
        get = self.numbers.get
        idx = list(map(get, words))
        if None in idx:
            gaps = [j for j, i in enumerate(idx) if i is None]
            missed = [words[j] for j in gaps]
            new, n = list(dict.fromkeys(missed)), len(self.numbers)
            self.numbers.update(zip(new, range(n, n + len(new)), strict=True))
            made = np.array([[xxhash.xxh64_intdigest(w) for w in new], *([xxhash.xxh64_intdigest(w[:k], k) for w in new] for k in STEMS)], np.uint64)
            while n + len(new) > len(self.marked):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
                self.marked = np.concatenate([self.marked, np.zeros_like(self.marked)])
            self.hashes[:, n : n + len(new)] = made
            if self.bears is not None:
                marked = self.bears[(made >> _SHIFT).astype(np.int64)].any(0)
                for k in TIMES:
                    marked |= self.bears[((made[1:] + np.uint64(k)) * _C >> _SHIFT).astype(np.int64)].any(0)
                self.marked[n : n + len(new)] = marked
            for j, i in zip(gaps, map(get, missed), strict=True):
                idx[j] = i
        return np.array(idx, np.int64)


@lru_cache(maxsize=1)
def _words() -> Words:
    return Words()


def _alone(h: np.ndarray) -> list[np.ndarray]:
    """Hashed features of words by themselves and by their stems."""
    often = []
    for stem in h[1:]:
        stem = np.sort(stem)
        for n in TIMES:
            some = stem[: max(0, len(stem) - n + 1)]
            often.append((some[some == stem[n - 1 :]] + np.uint64(n)) * _C)
    return [h.ravel(), *often]


def _together(one: np.ndarray) -> list[np.ndarray]:
    return [(one[:-1] * _A + one[1:]) * _B, (one[:-2] * _C + one[2:]) * _A]


def features(text: bytes) -> np.ndarray:
    """Coordinates of a text's features, repeats included."""
    words = text.translate(_KEEP).split()
    if not words:
        return np.zeros(0, np.int32)
    own = _words()
    at = own.numbered(words)
    h = own.hashes[:, at]
    return (np.concatenate([*_alone(h), *_together(h[0])]) >> _SHIFT).astype(np.int32)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def orders(n: int, epochs: int) -> list[list[int]]:
    draw = np.random.default_rng(SEED)
    return [draw.permutation(n).tolist() for _ in range(epochs)]


def fit(rows: list[tuple[int, np.ndarray]], epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, coordinates and weights from (label, distinct coordinates) rows."""
    ones = sum(y for y, _ in rows)
    bias = math.log((ones + 1) / (len(rows) - ones + 19))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    shift = bias_n = 0.0
    for order in orders(len(rows), epochs):
        for y, at in (rows[i] for i in order):
            za, na = z[at], n[at]
            root = np.sqrt(na)
            w = np.where(np.abs(za) <= L1, 0.0, (np.sign(za) * L1 - za) / ((BETA + root) / ALPHA + L2))
            g = sigmoid(bias + shift + float(w.sum())) - y
            z[at] = za + g - (np.sqrt(na + g * g) - root) / ALPHA * w
            n[at] = na + g * g
            bias_n += g * g
            shift -= 0.02 * g / (1 + math.sqrt(bias_n))
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    at = np.flatnonzero(w)
    return bias + shift, at, w[at]


class Scorer:
    """Scores of texts by one model. Words that bear no weight are left out but for their pairs: the score is the same."""

    def __init__(self, bias: float, weights: np.ndarray):
        self.bias, self.weights, self.words = bias, weights, Words(weights)

    def score(self, text: bytes) -> float:
        words = text.translate(_KEEP).split()
        if not words:
            return sigmoid(self.bias)
        idx = self.words.numbered(words)
        some = self.words.hashes[:, idx[self.words.marked[idx]]]
        at = (np.concatenate([*_alone(some), *_together(self.words.hashes[0, idx])]) >> _SHIFT).astype(np.int32)
        at = at[self.words.bears[at]]
        return sigmoid(self.bias + float(self.weights[np.unique(at)].sum()))


def score_texts(texts: Iterable[bytes], bias: float, weights: np.ndarray) -> list[float]:
    scorer = Scorer(bias, weights)
    return [scorer.score(t) for t in texts]


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[float, np.ndarray]:
    """Bias and dense weights, fitted on at most `rows` labelled rows outside of the held-out fold."""
    spark = docs.sparkSession
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    ids = spark.createDataFrame([(r["doc_id"], r["y"], k) for k, r in enumerate(chosen)], "_id long, _y int, _k int")  # at most `rows`

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.unique(features(t.as_py() or b"")) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int32()))], ["k", "y", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for k, y, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                sample.setdefault(k, (int(y > 0), at.values.to_numpy(zero_copy_only=False)))
        bias, at, w = fit([sample[k] for k in sorted(sample)])
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([w], pa.list_(pa.float64()))], ["bias", "at", "w"])

    text = F.col("text").cast("binary")
    joined = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    joined = joined.groupBy("_k", "_y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    made = materialise(arrow_rows(joined, featurise, "k int, y int, at array<int>"), "toxicity-features")
    # at most `rows` rows are left for the one task that learns
    model = arrow_rows(made.coalesce(1), learn, "bias double, at array<int>, w array<double>").first()
    weights = np.zeros(1 << BITS)
    if model is None:
        return math.log(1 / 19), weights
    weights[np.array(model["at"], np.int64)] = model["w"]
    return model["bias"], weights


def score(docs: DataFrame, model: tuple[float, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t.as_py() or b"") for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    found = arrow_rows(docs.select("doc_id", F.col("text").cast("binary").alias("text")), rows, f"doc_id {kind}, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: tuple[float, np.ndarray]) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            s = [scorer.score(t.as_py() or b"") for t in b.column(at).cast(pa.binary())]
            yield b.filter(pa.array(np.array(s) < 0.5))

    return arrow_rows(docs, rows, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
