"""Operator 5, toxicity: classifier chains over toxicity categories.

Categories are predicted one after another by linear models over hashed features; the
probability of every earlier category is a feature of the later models. For training
those probabilities come from models that did not see the row (out-of-fold), so a later
link does not learn to trust fitted values that scoring cannot give it.

Features are the distinct words of the whole text and their leading 4 and 5 letters
(word stems carry toxicity in languages that inflect), valued log(1 + count).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold
from quire.llm.linear import Ftrl, Rows, sigmoid

BITS = 20
FOLDS = 3
MAX_TRAIN_ROWS = 8_000
THRESHOLD = 0.5
L1 = 12.0  # strong: a few hundred of a million stem features stay
WORD = re.compile(r"[^\W\d_]+")
_MEMO = 1 << 20


def label_categories() -> dict[str, Column]:
    """The chain over the columns of ``labels``: toxic at all, then what kind of text it is in.

    A null label column makes the category unknown (the row trains the other categories only).
    """
    toxic, quality = F.col("toxic"), F.col("quality")
    return {"toxic": toxic, "toxic_prose": toxic * quality, "toxic_junk": toxic * (1 - quality)}


def _stem_features(word: str, mask: int) -> tuple[int, ...]:
    crc = zlib.crc32
    return tuple({crc(x.encode("utf-8", "surrogatepass")) & mask for x in ("w" + word, "p" + word[:4], "q" + word[:5])})


class StemHasher:
    """Text -> (feature indices, values) through a bounded memo of the words seen by the task.

    With ``used`` (the features that some model gives a weight) all others are skipped.
    """

    def __init__(self, bits: int = BITS, used: np.ndarray | None = None):
        self.mask = (1 << bits) - 1
        self.used = used
        self.memo: dict[str, tuple[int, ...]] = {}

    def _ids(self, word: str) -> tuple[int, ...]:
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        ids = _stem_features(word, self.mask)
        if self.used is not None:
            ids = tuple(i for i in ids if self.used[i])
        self.memo[word] = ids
        return ids

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        counts: dict[int, int] = {}
        memo = self.memo
        for word, n in Counter(WORD.findall((text or "").lower())).items():
            ids = memo.get(word)
            if ids is None:
                ids = self._ids(word)
            for i in ids:
                counts[i] = counts.get(i, 0) + n
        index = np.fromiter(counts.keys(), np.int64, len(counts))
        order = np.argsort(index)
        return index[order], np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))[order]


@dataclass
class Chain:
    """Weights per category over features, earlier probabilities and bias (the last entry)."""

    names: list[str]
    bits: int
    weights: list[np.ndarray]  # each of size 2^bits + number of categories + 1

    def used(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, bool)
        for w in self.weights:
            out |= w[: 1 << self.bits] != 0
        return out

    def predict(self, rows: Rows) -> np.ndarray:
        """Probabilities, rows x categories, each link fed with those before it."""
        p = np.zeros((len(rows), len(self.names)))
        size = 1 << self.bits
        for k, w in enumerate(self.weights):
            p[:, k] = sigmoid(rows.dot(w) + p[:, :k] @ w[size : size + k] + w[-1])
        return p


def with_earlier(rows: Rows, size: int, earlier: np.ndarray) -> Rows:
    """Rows with the probabilities of earlier categories as features size, size + 1, ..."""
    if not earlier.shape[1]:
        return rows
    n, k = earlier.shape
    end = rows.start[1:]
    index = np.insert(rows.index, np.repeat(end, k), np.tile(size + np.arange(k, dtype=np.int32), n))
    value = np.insert(rows.value, np.repeat(end, k), earlier.ravel().astype(np.float32))
    return Rows(rows.start + k * np.arange(n + 1), index, value)


def fit_chain(rows: Rows, labels: np.ndarray, folds: np.ndarray, names: list[str], bits: int, n_folds: int = FOLDS) -> Chain:
    """Fit the links in order. ``labels`` is rows x categories with nan for unknown."""
    size = 1 << bits
    oof = np.zeros(labels.shape)
    weights = []
    for k in range(len(names)):
        x, y = with_earlier(rows, size, oof[:, :k]), labels[:, k]
        known = ~np.isnan(y)
        model = Ftrl(size + len(names), l1=L1, free=len(names) + 1)
        for f in range(n_folds):
            rest, out = np.flatnonzero(known & (folds != f)), np.flatnonzero(folds == f)
            w = model.fit(x.take(rest), y[rest])
            oof[out, k] = sigmoid(x.take(out).dot(w) + w[-1])
        every = np.flatnonzero(known)
        weights.append(model.fit(x.take(every), y[every]))
    return Chain(names, bits, weights)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None,
    max_rows: int = MAX_TRAIN_ROWS, bits: int = BITS, n_folds: int = FOLDS,
) -> Chain:
    """Learn the chain in one task from at most ``max_rows`` labelled documents (those with the smallest id hash).

    ``max_rows`` is the documented bound of the fit. Null ids and ids whose labels disagree
    are left out; a doc_id that repeats counts once, with its smallest text. No usable
    labels: a chain of constant models at 0.5, which rejects nothing above that.
    """
    categories = categories or label_categories()
    names = list(categories)
    cat = [c.cast("double").alias(f"__c{k}") for k, c in enumerate(categories.values())]
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__id"), *cat)
    agree = known.groupBy("__id").agg(
        *[F.min(f"__c{k}").alias(f"__c{k}") for k in range(len(names))],
        *[F.max(f"__c{k}").alias(f"__m{k}") for k in range(len(names))],
    )
    for k in range(len(names)):
        agree = agree.where(F.col(f"__c{k}").eqNullSafe(F.col(f"__m{k}")))
    agree = agree.where(" or ".join(f"__c{k} is not null" for k in range(len(names))))
    chosen = agree.orderBy(F.xxhash64("__id"), "__id").limit(max_rows).select(
        "__id", F.array(*[F.col(f"__c{k}") for k in range(len(names))]).alias("y"), fold(F.col("__id"), n_folds).cast("int").alias("fold")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    # at most max_rows narrow rows: the texts stay where they are
    rows = rows.join(F.broadcast(chosen), "__id").groupBy("__id", "y", "fold").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = StemHasher(bits)
        for b in batches:
            made = [hasher(t.as_py()) for t in b.column(3)]
            yield pa.record_batch(
                [b.column(0), b.column(1), b.column(2), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())),
                 pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))],
                names=["id", "y", "fold", "i", "v"],
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, fs, made = [], [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            ys += [[np.nan if v is None else v for v in y] for y in b.column(1).to_pylist()]
            fs += b.column(2).to_pylist()
            made += [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(b.column(3), b.column(4), strict=True)]
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        y = np.array(ys, np.float64).reshape(-1, len(names))[order]
        chain = fit_chain(Rows.of([made[i] for i in order]), y, np.array(fs, np.int64)[order], names, bits, n_folds)
        for k, w in enumerate(chain.weights):
            at = np.flatnonzero(w)
            yield pa.record_batch([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int64()), pa.array(w[at])], names=["k", "i", "w"])

    hashed = rows.select("__id", "y", "fold", "text").mapInArrow(features, "id long, y array<double>, fold int, i array<int>, v array<float>")
    weights = [np.zeros((1 << bits) + len(names) + 1) for _ in names]
    for r in hashed.repartition(1).mapInArrow(train, "k int, i long, w double").toLocalIterator():
        weights[r.k][r.i] = r.w
    return Chain(names, bits, weights)


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with ``toxicity`` (array of struct<category, p>), ``toxic_p`` (the largest) and ``rejected``.

    One pass over whole texts, no shuffle. Only the text and a row's other columns as they are
    go through the task; the added names replace columns of the same name. Null and empty texts
    score by the bias alone. Equal rows score equally. The broadcast chain has a fixed size.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        (chain.names, chain.bits, [(np.flatnonzero(w), w[np.flatnonzero(w)]) for w in chain.weights])
    )
    threshold = float(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bits, sparse = model.value
        own = Chain(names, bits, [np.zeros((1 << bits) + len(names) + 1) for _ in names])
        for w, (at, v) in zip(own.weights, sparse, strict=True):
            w[at] = v
        hasher = StemHasher(bits, own.used())
        for b in batches:
            at = b.schema.get_field_index("text")
            p = own.predict(Rows.of([hasher(t.as_py()) for t in b.column(at)]))
            worst = p.max(axis=1) if len(p) else np.zeros(0)
            flat = pa.StructArray.from_arrays([pa.array(names * len(p), pa.string()), pa.array(p.ravel())], ["category", "p"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(names)), flat)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, lists, pa.array(worst), pa.array(worst >= threshold)], names=[*b.schema.names, "toxicity", "toxic_p", "rejected"]
            )

    kept = docs.drop("toxicity", "toxic_p", "rejected")
    kept = kept.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, toxicity array<struct<category:string,p:double>>, toxic_p double, rejected boolean")
