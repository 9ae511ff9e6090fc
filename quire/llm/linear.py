"""Sparse logistic regression with follow-the-regularised-leader (FTRL-proximal) updates, in numpy.

Small helper of the classifiers: rows are (indices, values) pairs in a hashed feature
space, models are weight vectors most of whose entries the L1 term keeps at zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass
class Rows:
    """Sparse rows: row i holds index[start[i]:start[i + 1]] with value alike."""

    start: np.ndarray
    index: np.ndarray  # int32
    value: np.ndarray  # float32

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        start = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(i) for i, _ in rows], out=start[1:])
        index = np.empty(start[-1], np.int32)
        value = np.empty(start[-1], np.float32)
        for k, (i, v) in enumerate(rows):
            index[start[k] : start[k + 1]] = i
            value[start[k] : start[k + 1]] = v
        return cls(start, index, value)

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, which: np.ndarray) -> Rows:
        n = self.start[which + 1] - self.start[which]
        start = np.zeros(len(which) + 1, np.int64)
        np.cumsum(n, out=start[1:])
        at = np.repeat(self.start[which] - start[:-1], n) + np.arange(start[-1])
        return Rows(start, self.index[at], self.value[at])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(weights[self.index] * self.value, dtype=np.float64)])
        return total[self.start[1:]] - total[self.start[:-1]]


@dataclass
class Ftrl:
    """FTRL-proximal with per-coordinate rates; the bias is the last coordinate."""

    size: int
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 0.1
    epochs: int = 4
    batch: int = 16
    seed: int = 13
    free: int = 1  # last coordinates without a penalty: the bias and, before it, dense extras

    def fit(self, rows: Rows, labels: np.ndarray) -> np.ndarray:
        """Weights (size + 1 values). Rows come in a seeded order; one class only gives a constant model."""
        z, n = np.zeros(self.size + 1), np.zeros(self.size + 1)
        l1 = np.full(self.size + 1, self.l1)
        l2 = np.full(self.size + 1, self.l2)
        l1[-self.free :] = l2[-self.free :] = 0.0

        def weights(i):
            zi = z[i]
            return np.where(np.abs(zi) <= l1[i], 0.0, (np.sign(zi) * l1[i] - zi) / ((self.beta + np.sqrt(n[i])) / self.alpha + l2[i]))

        if len(labels) == 0 or labels.min() == labels.max():
            out = np.zeros(self.size + 1)
            m = len(labels)
            p = (labels.sum() + 0.5) / (m + 1.0) if m else 0.5
            out[-1] = np.log(p / (1 - p))
            return out
        rng = np.random.default_rng(self.seed)
        for _ in range(self.epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), self.batch):
                part = order[at : at + self.batch]
                r = rows.take(part)
                f, inverse = np.unique(r.index, return_inverse=True)
                f = np.append(f, self.size)
                w = weights(f)
                x = np.bincount(np.repeat(np.arange(len(part)), np.diff(r.start)), weights=w[inverse] * r.value, minlength=len(part))
                err = sigmoid(x + w[-1]) - labels[part]
                g = np.bincount(inverse, weights=np.repeat(err, np.diff(r.start)) * r.value, minlength=len(f))
                g[-1] = err.sum()
                sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / self.alpha
                z[f] += g - sigma * w
                n[f] += g * g
        return weights(np.arange(self.size + 1))
