"""Operator 9, quality classifier: hashed word n-gram logistic regression trained by FTRL, scored as sparse dot products.

Tokens of a whole text are its runs of word characters and its runs of symbols, in lower
case; a token that repeats the one before it is written as one shared "same again" token,
so stuttering text looks alike in every language. Features are hashed 1- and 2-grams with
the value sqrt(count / tokens): they do not grow with the length of a text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold
from quire.llm.linear import Ftrl, Rows, sigmoid

BITS = 18
MAX_TRAIN_ROWS = 12_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
_SAME = 0x5BD1E995
_MEMO = 1 << 20


class NgramHasher:
    """Text -> (feature indices, values); words are hashed once per task through a bounded memo."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.memo: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        h = self.memo[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) or 1
        return h

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = TOKEN.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        get = self.memo.get
        h = np.fromiter((get(w) or self._hash(w) for w in words), np.uint64, len(words))
        h[1:][h[1:] == h[:-1]] = _SAME
        two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        one = h * np.uint64(0xFF51AFD7ED558CCD)
        mixed = np.concatenate([one, two])
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        index, count = np.unique((mixed >> np.uint64(32)) & self.mask, return_counts=True)
        return index.astype(np.int64), np.sqrt(count / len(words))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """text and label of at most ``max_rows`` labelled documents outside the held-out fold.

    The sample is the documented bound of the fit: the rows with the smallest hash of their
    id. Null labels, null ids and ids labelled twice with different values are left out.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("__m"))
    known = known.where("y = __m").where(fold(F.col("doc_id"), modulus) != held_out)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").cast("long").alias("__id"), F.col("y").cast("int").alias("y"))
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    # a doc_id that repeats counts once, with its smallest text
    # at most max_rows narrow rows: the texts stay where they are
    return rows.join(F.broadcast(chosen), "__id").groupBy("__id", "y").agg(F.min("text").alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights of the classifier, learned in one task from the bounded sample; the driver gets the non-zero ones only."""
    rows = training_rows(docs, labels, label, max_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = NgramHasher(bits)
        for b in batches:
            made = [hasher(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())),
                 pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))],
                names=["id", "y", "i", "v"],
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, made = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
            made += [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(b.column(2), b.column(3), strict=True)]
        order = np.argsort(np.array(ids, np.int64), kind="stable")  # the same model whatever order the rows come in
        w = Ftrl(1 << bits).fit(Rows.of([made[i] for i in order]), np.array(ys, np.float64)[order])
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["i", "w"])

    hashed = rows.select("__id", "y", "text").mapInArrow(features, "id long, y int, i array<int>, v array<float>")
    out = np.zeros((1 << bits) + 1)
    for r in hashed.repartition(1).mapInArrow(train, "i long, w double").toLocalIterator():
        out[r.i] = r.w
    return out


def score_quality(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7, bits: int = BITS) -> DataFrame:
    """doc_id, score, predicted per row of ``docs``: one pass over the whole texts, no shuffle.

    The broadcast model has a fixed size of 2^bits + 1 numbers. Null and empty texts get the
    score of the bias alone. Equal rows give equal rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w = NgramHasher(bits), model.value
        for b in batches:
            x = np.empty(b.num_rows)
            for k, t in enumerate(b.column(1)):
                i, v = hasher(t.as_py())
                x[k] = w[i] @ v + w[-1]
            p = sigmoid(x)
            yield pa.record_batch([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int"
    )
