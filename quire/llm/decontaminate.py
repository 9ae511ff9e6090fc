"""Operator 6, benchmark decontamination by latent semantic retrieval.

1. Document frequencies of all words of all documents, in a hashed table of fixed size.
2. Passages are TF-IDF vectors over the benchmark's words and the CONTEXT words of largest
   mass in the corpus; a randomised SVD of the passage matrix A gives the latent space: every
   task sketches its passages (Y = A'A X, where X are seeded random combinations of the
   items), the sketches are summed by blocks of terms, and the Gram matrix is rebuilt from
   them by the Nystroem formula. The space has at most SKETCH directions and half as many as
   there are items; the items are folded in, so their latent vectors hold the words that stand
   beside theirs in the corpus, and of their own words what the space keeps.
3. Every passage of every text is compared with every item by the cosine of the passage with
   the item's latent vector (its components that hold MASS of its squared length); the norm
   of the passage counts all its words. Passages follow the item's length: items
   of 2^(k-1/2) to 2^(k+1/2) words meet windows of 2^k words, 2^(k-1) apart, so a copy fills
   most of a window and most of a copy lies in one.
4. Candidates are verified on the words around the passage: longest common subsequence in
   any stretch of twice the item's length, and, for paraphrases, the item's answer (its
   last sentence, or what follows its last question mark).
5. Latent cosines pass over copies whose other words are heavy and over items whose words
   stand nowhere else, so candidates are the union with stretches found by their words: a stretch that reaches the LCS limit of L of an item's n words holds at
   least m of its n - L + m heaviest words, whatever m is. That is a bound, not a cut.
6. Beside both, the heaviest words in a row of each item (ANCHOR of them) are looked
   up at every word of every text and the item compared there word by word, so that a copy
   without a change is found at any length and between any other words.

TF weight is sqrt(tf), so squared norms add up over words: a passage whose known words
hold less than cosine^2 of its squared norm cannot reach the cosine and is passed over
without a product. That is a bound, not a cut.

The benchmark is the stated query set. Its items are held by every task in blocks of at
most ITEMS_PER_BLOCK; a larger benchmark is done block by block.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import groups, hash_words, mix

ITEMS_PER_BLOCK = 512
DF_BITS = 20
HALF = 16  # half a window of the corpus sketch
ANCHOR = 4  # words in a row by which copies without a change are looked up
SKETCH = 32  # random directions of the corpus sketch
CONTEXT = 2048  # words of the latent space beside the benchmark's own
MASS = 0.95  # share of a latent vector's squared length that its kept components hold
COSINE = 0.35
LCS_ALONE = 0.8
LCS_WITH_ANSWER = 0.55
ANSWER_LCS = 0.8
MIN_WORDS = 4  # shorter items are searched for word for word only
COMMON = 0.5  # words in more than this share of the documents have weight 0
SMOOTH = 20  # documents without a word, added to the frequencies
TERM_BLOCK = 512
_BYTES_AT_ONCE = 1 << 20
_SENTENCE = re.compile(r"[.!?\n]+")
# ASCII letters and digits and all bytes of other characters make words; the marks of the
# Latin-1, general and CJK punctuation blocks are taken out first, where a text has any
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# scripts without blanks between words: every character is a word (kana, Han, Thai, Lao, Myanmar, Khmer, half-width kana)
_UNSPACED = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
                       "\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_MARKS = re.compile(rb"\xc2[\xa0-\xbf]|\xe2\x80[\x80-\xbf]|\xe2\x81[\x80-\xaf]|\xe3\x80[\x80-\xbf]|\xef\xbc[\x81-\x8f\x9a-\xa0]")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a text as UTF-8."""
    return raw_text(text).translate(_TABLE).split()


def raw_text(text: str | None) -> bytes:
    """Lower-case UTF-8 without the marks: what the word hasher reads."""
    low = (text or "").lower()
    if low.isascii():
        return low.encode()
    return _MARKS.sub(b" ", _UNSPACED.sub(r" \g<0> ", low).encode("utf-8", "replace"))


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)


def answer_of(text: str) -> list[bytes]:
    """Words of the answer: after the last question mark, else the last sentence of three words or more."""
    tail = words_of(text.rsplit("?", 1)[1]) if "?" in text else []
    if len(tail) >= 1:
        return tail
    for part in reversed(_SENTENCE.split(text)):
        if len(words_of(part)) >= 3:
            return words_of(part)
    return words_of(text)


def lcs_length(masks: dict[int, int], full: int, sequence: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; ``masks`` has the item's positions by word."""
    v = full
    for s in sequence:
        if (m := masks.get(s)) is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full.bit_count() - v.bit_count()


# --- step 1: document frequencies --------------------------------------------------------


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and, per hash bucket, an upper bound of the documents that hold a word.

    Tasks count into one array of 2^DF_BITS buckets; the arrays meet block by block. The
    result on the driver has that fixed size whatever the corpus is.
    """
    block = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(1 << DF_BITS, np.int64), 0
        for b in batches:
            n += b.num_rows
            for texts in groups(raw_text(t.as_py()) for t in b.column(0)):
                h, first = hash_words(texts, _TABLE)
                row = np.repeat(np.arange(len(texts)), np.diff(first))
                key = row << DF_BITS | buckets(h)
                key.sort()
                once = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]  # a bucket counts once per document
                np.add.at(table, once & ((1 << DF_BITS) - 1), 1)
        parts = table.reshape(-1, block)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.record_batch(
            [pa.array(np.append(some, -1), pa.int32()),
             pa.array([*(parts[i].astype(np.uint32).tobytes() for i in some), np.array([n], np.int64).tobytes()], pa.binary())],
            names=["part", "counts"],
        )

    total = np.zeros(1 << DF_BITS, np.int64)
    n = 0
    partial = docs.select(F.col("text").cast("string").alias("t")).mapInArrow(count, "part int, counts binary")
    for r in _summed(partial, "uint32", "int64").toLocalIterator():
        if r.part < 0:
            n = int(np.frombuffer(r.counts, np.int64)[0])
        else:
            total[r.part * block : (r.part + 1) * block] = np.frombuffer(r.counts, np.int64)
    return n, total


def _summed(parts: DataFrame, kind: str, total: str) -> DataFrame:
    """Sum binary arrays by ``part`` as they stream in: one array in memory at a time. Part -1 holds int64 counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sum_ = None, None
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                a = np.frombuffer(raw.as_buffer(), np.int64 if part < 0 else kind).astype(np.int64 if part < 0 else total)
                if part != now:
                    if now is not None:
                        yield pa.record_batch([pa.array([now], pa.int32()), pa.array([sum_.tobytes()], pa.binary())], names=["part", "counts"])
                    now, sum_ = part, a
                else:
                    sum_ = sum_ + a
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.int32()), pa.array([sum_.tobytes()], pa.binary())], names=["part", "counts"])

    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, counts binary")


# --- step 2: passages and the latent space -----------------------------------------------


@dataclass
class Items:
    """A block of benchmark items over its own vocabulary."""

    ids: list[int | None]
    words: list[list[int]]
    answers: list[list[int]]
    terms: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]], min_words: int = 1) -> Items:
        terms: dict[bytes, int] = {}
        out = cls([], [], [], terms)
        for item_id, text in rows:
            w = words_of(text)
            if len(w) >= min_words:
                out.ids.append(item_id)
                out.words.append([terms.setdefault(x, len(terms)) for x in w])
                out.answers.append([terms.setdefault(x, len(terms)) for x in answer_of(text)])
        return out


class Passages:
    """Texts -> term ids (or -1) and squared idf weights of their words, in half-window blocks.

    Words whose bucket is the i-th of ``context`` have the id ``len(terms) + i``.
    """

    def __init__(self, terms: dict[bytes, int], weight2: np.ndarray, context: np.ndarray | None = None):
        self.weight2 = weight2
        self.context = None
        if context is not None:
            self.context = np.full(1 << DF_BITS, -1, np.int32)
            self.context[context] = len(terms) + np.arange(len(context))
        hashes = hash_terms(terms)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.some = np.zeros(1 << DF_BITS, bool)  # buckets that hold a term
        self.some[buckets(hashes)] = True

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, first = hash_words(texts, _TABLE)
        at = buckets(h)
        term = np.full(len(h), -1, np.int32) if self.context is None else self.context[at]
        maybe = np.flatnonzero(self.some[at])
        if len(maybe):
            k = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
            term[maybe] = np.where(self.sorted[k] == h[maybe], self.order[k], -1)  # a term's bucket is no context
        return term, self.weight2[at], first

    def groups(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, words of each row, term, w2, first block of each row plus the total).

        Texts lie one after another, each padded to whole blocks (two at least); texts
        without words are left out.
        """
        for done, term, w2, first in self.runs(texts):
            rows, padded, weights, starts = blocks_of(term, w2, first, HALF)
            if len(rows):
                yield rows + done, [term[first[r] : first[r + 1]] for r in rows], padded, weights, starts

    def runs(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(texts before, term, w2, first word of each text plus the total) for runs of texts."""
        done = 0
        for run in groups((raw_text(t) for t in texts), _BYTES_AT_ONCE):
            yield done, *self.words(run)
            done += len(run)


def blocks_of(term: np.ndarray, w2: np.ndarray, first: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows with words, padded term, padded w2, first block of each such row plus the total) in blocks of ``half`` words."""
    n = np.diff(first)
    rows = np.flatnonzero(n)
    blocks = np.maximum(2, -(-n[rows] // half))
    starts = np.concatenate([[0], np.cumsum(blocks)])
    at = np.repeat(starts[:-1] * half - first[rows], n[rows]) + np.arange(len(term))
    padded, weights = np.full(starts[-1] * half, -1, np.int32), np.zeros(starts[-1] * half, np.float32)
    padded[at], weights[at] = term, w2
    return rows, padded, weights, starts


def half_of(words: int) -> int:
    """Half the window of an item: the window is the power of two next to its length, by ratio, and 2 at least."""
    return 1 << max(0, round(math.log2(words)) - 1)


class Copies:
    """Items by their heaviest words in a row: finds every place where an item stands word for word."""

    def __init__(self, items: Items, weight: np.ndarray):
        self.words = [np.array(w, np.int32) for w in items.words]
        self.by_length: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for j, w in enumerate(self.words):
            k = min(ANCHOR, len(w))
            at = int(np.argmax(np.convolve(weight[w], np.ones(k), "valid")))
            key = int(self._hash(w[at : at + k], k)[0])
            self.by_length.setdefault(k, {}).setdefault(key, []).append((j, at))
        self.keys = {k: np.sort(np.array(list(d), np.uint64)) for k, d in self.by_length.items()}
        self.some = {}
        for k, keys in self.keys.items():
            self.some[k] = np.zeros(1 << DF_BITS, bool)
            self.some[k][buckets(keys)] = True

    @staticmethod
    def _hash(term: np.ndarray, k: int) -> np.ndarray:
        t = mix((term.astype(np.int64) + 2).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out = t[: len(t) - k + 1]
        for i in range(1, k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + t[i : len(t) - k + 1 + i]
        return mix(out)

    def find(self, term: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, first word within the text): the first copy of every item in every text."""
        for k, keys in self.keys.items():
            if len(term) < k:
                continue
            h = self._hash(term, k)
            maybe = np.flatnonzero(self.some[k][buckets(h)])
            at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            same = keys[at] == h[maybe]
            maybe, at = maybe[same], at[same]
            for key in np.unique(at):
                place = maybe[at == key]
                for item, before in self.by_length[k][int(keys[key])]:
                    w = self.words[item]
                    start = place - before
                    start = start[(start >= 0) & (start + len(w) <= len(term))]
                    row = np.searchsorted(first, start, side="right") - 1
                    start = start[start + len(w) <= first[row + 1]]
                    for i, x in enumerate(w):
                        start = start[term[start + i] == x]
                        if not len(start):
                            break
                    row, one = np.unique(np.searchsorted(first, start, side="right") - 1, return_index=True)
                    for r, s in zip(row.tolist(), start[one].tolist(), strict=True):
                        yield r, item, s - int(first[r])


def hash_terms(terms: dict[bytes, int]) -> np.ndarray:
    return hash_words(list(terms), _TABLE)[0]


def sparse_windows(term: np.ndarray, weight: np.ndarray, window: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (window, term) with the value sqrt(tf) x idf, sorted by window."""
    key, count = np.unique(window.astype(np.int64) * n_terms + term, return_counts=True)
    t = key % n_terms
    return key // n_terms, t, np.sqrt(count) * weight[t]


def sum_rows(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted ``index`` and the sums of the rows of ``values`` per index (``index`` is sorted)."""
    start = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[start], np.add.reduceat(values, start, axis=0)


def context_buckets(df: np.ndarray, weight2: np.ndarray, items: Items, size: int = CONTEXT) -> np.ndarray:
    """The ``size`` buckets of largest mass, documents x squared weight, that hold no word of the items; sorted."""
    mass = df * weight2
    mass[buckets(hash_terms(items.terms))] = 0.0
    top = np.lexsort((np.arange(len(mass)), -mass))[:size]
    return np.sort(top[mass[top] > 0])


def start_vectors(b: np.ndarray, sketch: int, seed: int) -> np.ndarray:
    """Seeded random combinations of the items: the sketch looks at what stands beside their words."""
    return b @ np.random.default_rng(seed).standard_normal((b.shape[1], sketch))


def corpus_sketch(
    docs: DataFrame, items: Items, weight2: np.ndarray, context: np.ndarray, sketch: int = SKETCH, seed: int = 5
) -> np.ndarray:
    """Y = A'A X, terms and context x sketch, over the non-overlapping windows A of all texts."""
    weight = space_weights(items, weight2, context)
    n, own = len(weight), len(items.terms)
    x = start_vectors(item_vectors(items, weight), sketch, seed)[:own].astype(np.float32)  # the items have no context words
    held = docs.sparkSession.sparkContext.broadcast((items.terms, weight2.astype(np.float32), context, weight, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, w2, context, weight, x = held.value
        passages = Passages(terms, w2, context)
        y = np.zeros((n, x.shape[1]), np.float64)
        for b in batches:
            for _, _, term, _, starts in passages.groups(t.as_py() for t in b.column(0)):
                hit = np.flatnonzero(term >= 0)
                hit = hit[weight[term[hit]] > 0]
                block = hit // HALF
                row = np.searchsorted(starts, block, side="right") - 1
                window = starts[row] * 2 + (block - starts[row]) // 2  # pairs of blocks within a text
                told = np.unique(window[term[hit] < own])  # a window without a word of the items adds nothing
                if not len(told):
                    continue
                keep = np.zeros(window[-1] + 1, bool)
                keep[told] = True
                keep = keep[window]
                win, t, v = sparse_windows(term[hit[keep]], weight, window[keep], n)
                v = v.astype(np.float32)[:, None]
                mine = t < own
                w, z = sum_rows(win[mine], v[mine] * x[t[mine]])
                part = v * z[np.searchsorted(w, win)]
                order = np.argsort(t, kind="stable")
                t, s = sum_rows(t[order], part[order])
                y[t] += s
        for at in range(0, n, TERM_BLOCK):
            if y[at : at + TERM_BLOCK].any():
                raw = y[at : at + TERM_BLOCK].astype(np.float32).tobytes()
                yield pa.record_batch([pa.array([at // TERM_BLOCK], pa.int32()), pa.array([raw], pa.binary())], names=["part", "counts"])

    out = np.zeros((n, sketch))
    partial = docs.select(F.col("text").cast("string").alias("t")).mapInArrow(run, "part int, counts binary")
    for r in _summed(partial, "float32", "float64").toLocalIterator():
        block = np.frombuffer(r.counts, np.float64).reshape(-1, sketch)
        out[r.part * TERM_BLOCK : r.part * TERM_BLOCK + len(block)] = block
    held.unpersist()
    return out


def term_weights(items: Items, weight2: np.ndarray) -> np.ndarray:
    return np.sqrt(weight2[buckets(hash_terms(items.terms))]).astype(np.float32)


def space_weights(items: Items, weight2: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Weights of the items' words, then of the context."""
    return np.concatenate([term_weights(items, weight2), np.sqrt(weight2[context])]).astype(np.float32)


def item_vectors(items: Items, weight: np.ndarray) -> np.ndarray:
    """words of the space x items, columns of length 1 (0 where an item has no weighted word)."""
    b = np.zeros((len(weight), len(items.ids)))
    for j, w in enumerate(items.words):
        t, c = np.unique(np.array(w), return_counts=True)
        b[t, j] = np.sqrt(c) * weight[t]
    norm = np.linalg.norm(b, axis=0)
    return b / np.where(norm > 0, norm, 1.0)


def latent_items(items: Items, weight: np.ndarray, y: np.ndarray, seed: int = 5, mass: float = MASS) -> np.ndarray:
    """words of the space x items: every item projected on the latent space, scaled to length 1 there.

    A passage's product with a column, over the passage's whole norm, is its latent cosine. An
    item of which the space keeps nothing (its words stand in no passage) has a column of zeros.
    """
    b = item_vectors(items, weight)
    x = start_vectors(b, y.shape[1], seed)
    q, _ = np.linalg.qr(y)
    qy, core = q.T @ y, x.T @ y
    # Nystroem: A'A ~ Y (X'Y)^+ Y'
    gram = qy @ np.linalg.pinv((core + core.T) / 2, rcond=1e-10, hermitian=True) @ qy.T
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    best = np.argsort(values)[::-1][: max(1, min(y.shape[1], b.shape[1] // 2))]
    v = q @ vectors[:, best[values[best] > 1e-9 * max(values.max(), 0.0)]]
    latent = v @ (v.T @ b)
    size = latent**2
    order = np.argsort(-size, axis=0, kind="stable")
    before = np.cumsum(np.take_along_axis(size, order, axis=0), axis=0) - np.take_along_axis(size, order, axis=0)
    kept = np.zeros(latent.shape, bool)
    np.put_along_axis(kept, order, before < mass * size.sum(axis=0), axis=0)
    latent = np.where(kept, latent, 0.0)
    norm = np.linalg.norm(latent, axis=0)
    return (latent / np.where(norm > 1e-12, norm, np.inf)).astype(np.float32)


# --- steps 3 and 4: candidates and verification ---------------------------------------------


class Verifier:
    def __init__(self, items: Items, lcs_alone: float, lcs_with_answer: float, answer_lcs: float):
        self.items = items
        self.limits = lcs_alone, lcs_with_answer, answer_lcs
        self.masks = [self._masks(w) for w in items.words]
        self.answer_masks = [self._masks(w) for w in items.answers]

    @staticmethod
    def _masks(words: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def check(self, item: int, region: list[int]) -> tuple[float, float] | None:
        """Best LCS share of the item, with that of its answer, in any stretch of twice its length; None if no leak.

        Exact: the best stretch can begin at its first word that the item has, so every such
        place is a beginning. From one beginning to a later one the LCS gains at most the item's
        words that enter at the end, so those that cannot reach what is wanted are passed over.
        """
        alone, paired, answered = self.limits
        n, masks = len(self.items.words[item]), self.masks[item]
        full, least = (1 << n) - 1, min(alone, paired) * n
        m = len(self.items.answers[item])
        answer_masks, answer_full = self.answer_masks[item], (1 << m) - 1
        places = [k for k, w in enumerate(region) if w in masks]
        ends = [bisect_left(places, p + 2 * n) for p in places]  # places inside the stretch from each beginning
        best, at = None, 0
        while at < len(places):
            if ends[at] - at < least and ends[at] == len(places):
                break  # what is left is too few
            found = lcs_length(masks, full, [region[k] for k in places[at : ends[at]]]) if ends[at] - at >= least else ends[at] - at
            share = found / n
            if found >= least and ends[at] - at >= least:
                a = lcs_length(answer_masks, answer_full, region[places[at] : places[at] + 2 * n]) / m
                if (share >= alone or share >= paired and a >= answered) and (best is None or (share, a) > best):
                    best = share, a
                    if share == 1.0 and a == 1.0:
                        break
            # with a leak found, only a better one is of interest
            missing = math.ceil(best[0] * n if best else least) - found
            at = at + 1 if missing <= 0 else max(at + 1, bisect_left(ends, ends[at] + missing))
        return best


class Shared:
    """Items by their heaviest words: finds every stretch in which the LCS limit can be reached."""

    def __init__(self, items: Items, weight: np.ndarray, share: float):
        self.width = np.array([2 * len(w) for w in items.words])
        self.least = np.zeros(len(items.words), np.int64)
        terms, of = [], []
        for j, w in enumerate(items.words):
            if len(w) < MIN_WORDS:
                continue
            reach = max(1, math.ceil(share * len(w) - 1e-9))
            self.least[j] = min(reach, max(2, -(-reach // 3)))
            heavy = np.argsort(-weight[w], kind="stable")[: len(w) - reach + self.least[j]]
            t = np.unique(np.array(w)[heavy])
            terms.append(t)
            of.append(np.full(len(t), j))
        terms, of = np.concatenate([np.zeros(0, np.int64), *terms]), np.concatenate([np.zeros(0, np.int64), *of])
        self.items = of[np.argsort(terms, kind="stable")].astype(np.int32)
        self.count = np.append(np.bincount(terms, minlength=len(items.terms)), 0)  # the last: words of no item
        self.begin = np.cumsum(self.count) - self.count

    def find(self, term: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, end) of the stretches, those that overlap taken together."""
        n = self.count[term]
        hit = np.flatnonzero(n)
        n = n[hit]
        pos = np.repeat(hit, n)
        item = self.items[np.repeat(self.begin[term[hit]] - (np.cumsum(n) - n), n) + np.arange(len(pos))]
        order = np.argsort(item, kind="stable")
        item, pos = item[order], pos[order]
        end = np.arange(len(item)) + self.least[item] - 1
        a = np.flatnonzero(end < len(item))
        end = end[a]
        close = (item[end] == item[a]) & (pos[end] - pos[a] < self.width[item[a]])
        a, end = a[close], end[close]
        row = np.searchsorted(first, pos[a], side="right") - 1
        inside = pos[end] < first[row + 1]
        a, end, row = a[inside], end[inside], row[inside]
        if not len(a):
            return
        width, item = self.width[item[a]], item[a]
        lo, hi = np.maximum(first[row], pos[end] - width + 1), np.minimum(first[row + 1], pos[a] + width)
        new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (lo[1:] >= hi[:-1])]))
        last = np.append(new[1:], len(a)) - 1
        yield from zip(row[new].tolist(), item[new].tolist(), (lo[new] - first[row[new]]).tolist(), (hi[last] - first[row[new]]).tolist(), strict=True)


def passage_cosine(term: np.ndarray, w2: np.ndarray, weight: np.ndarray, vector: np.ndarray) -> float:
    """Latent cosine of one passage with one item."""
    t, c = np.unique(term[term >= 0], return_counts=True)
    norm2 = float(w2.sum(dtype=np.float64))
    return float((np.sqrt(c) * weight[t]) @ vector[t]) / math.sqrt(norm2) if norm2 > 0 else 0.0


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs_alone: float = LCS_ALONE,
    lcs_with_answer: float = LCS_WITH_ANSWER, answer_lcs: float = ANSWER_LCS, items_per_block: int = ITEMS_PER_BLOCK,
) -> DataFrame:
    """doc_id, text_md5, item_id, cosine, lcs, answer_lcs, first_word: a row per document row and item found in it.

    ``first_word`` is where the searched stretch begins. Where the item stands word for word,
    the passage is the item itself: it begins at ``first_word`` and its cosine is 1.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Whole texts, all windows.
    Null and empty texts hold no passage; null and empty items are not searched for, items
    under MIN_WORDS words only word for word. Characters of scripts without blanks between
    words are words. Repeated documents give a row each, repeated items one per
    item_id and text. Empty tables: no rows. Other columns are not read.
    """
    schema = "doc_id long, text_md5 string, item_id long, cosine double, lcs double, answer_lcs double, first_word long"
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    blocks = max(1, -(-rows.count() // items_per_block))
    n_docs, df = document_frequencies(docs)
    share = (df + 1.0) / (n_docs + SMOOTH)
    weight2 = np.where(share > COMMON, 0.0, np.log(share) ** 2)
    out = None
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        items = Items.of([(r.item_id, r.text) for r in part.toLocalIterator()])
        if not items.ids:
            continue
        context = context_buckets(df, weight2, items)
        y = corpus_sketch(docs, items, weight2, context)
        latent = latent_items(items, space_weights(items, weight2, context), y)
        found = _search(docs, items, weight2, context, latent, schema, cosine, lcs_alone, lcs_with_answer, answer_lcs)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _search(docs: DataFrame, items: Items, weight2, context, latent, schema: str, cosine: float, *limits: float) -> DataFrame:
    weight = space_weights(items, weight2, context)
    held = docs.sparkSession.sparkContext.broadcast((items, weight2.astype(np.float32), context, weight, latent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w2_table, context, weight, latent = held.value
        passages = Passages(items.terms, w2_table, context)
        verifier = Verifier(items, *limits)
        copies = Copies(items, weight)
        shared = Shared(items, weight, min(limits[:2]))
        whole = [verifier.check(j, w) for j, w in enumerate(items.words)]
        lengths = [len(w) for w in items.words]
        halves = np.array([half_of(n) if n >= MIN_WORDS else 0 for n in lengths])
        classes = [(int(h), np.flatnonzero(halves == h)) for h in np.unique(halves[halves > 0])]
        classes = [(h, of, np.ascontiguousarray(latent[:, of])) for h, of in classes]
        for b in batches:
            best: dict[tuple[int, int], tuple] = {}
            for done, known, w2, first in passages.runs(t.as_py() for t in b.column(2)):
                term = np.where(known < len(items.terms), known, -1)  # words of the items; known: the context's too
                exact = {(r, item): at for r, item, at in copies.find(term, first)}
                for (r, item), at in exact.items():
                    if whole[item]:
                        best[r + done, item] = (*whole[item], 1.0, at)
                for r, item, lo, hi in shared.find(term, first):
                    if (r, item) in exact:
                        continue
                    stretch = slice(first[r] + lo, first[r] + hi)
                    if hit := verifier.check(item, term[stretch].tolist()):
                        cos = passage_cosine(known[stretch], w2[stretch], weight, latent[:, item])
                        key = r + done, item
                        if key not in best or (*hit, cos) > best[key][:3]:
                            best[key] = (*hit, cos, lo)
                for half, of, vectors in classes:
                    rows, padded, weights, starts = blocks_of(known, w2, first, half)
                    if not len(rows):
                        continue
                    for k, j, at, cos in candidates(padded, weights, starts, weight, vectors, cosine, half):
                        r, item = int(rows[k]), int(of[j])
                        if (r, item) in exact:
                            continue
                        begin = (at - starts[k]) * half
                        lo = max(0, begin - lengths[item])
                        words = term[first[r] : first[r + 1]]
                        hit = verifier.check(item, words[lo : begin + 2 * half + lengths[item]].tolist())
                        key = r + done, item
                        if hit and (key not in best or (*hit, cos) > best[key][:3]):
                            best[key] = (*hit, cos, lo)
            hits = sorted(best.items())
            take = pa.array([row for (row, _), _ in hits], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array([items.ids[i] for (_, i), _ in hits], pa.int64()),
                 pa.array([float(v[2]) for _, v in hits], pa.float64()), pa.array([v[0] for _, v in hits], pa.float64()),
                 pa.array([v[1] for _, v in hits], pa.float64()), pa.array([int(v[3]) for _, v in hits], pa.int64())],
                names=["doc_id", "text_md5", "item_id", "cosine", "lcs", "answer_lcs", "first_word"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("m"), text.alias("t")).mapInArrow(run, schema)


def candidates(
    term: np.ndarray, w2: np.ndarray, starts: np.ndarray, weight: np.ndarray, latent: np.ndarray, cosine: float, half: int = HALF
) -> Iterator[tuple[int, int, int, float]]:
    """(row, item, first block, cosine) of the windows (two blocks of one text) that reach the cosine."""
    n_blocks = len(term) // half
    known = term >= 0

    def per_window(values: np.ndarray) -> np.ndarray:
        blocks = values.reshape(-1, half).sum(axis=1, dtype=np.float64)
        return blocks[:-1] + blocks[1:]

    inside = np.ones(n_blocks - 1, bool)
    inside[starts[1:-1] - 1] = False  # a window does not run into the next text
    norm2 = per_window(w2)
    own2 = per_window(np.where(known, w2, 0.0))
    # no item gives a word more than its largest latent weight: a second bound
    most = np.append(weight * latent.max(axis=1, initial=0.0), 0.0).astype(np.float32)
    reach = per_window(most[term])
    least = cosine * 0.999
    windows = np.flatnonzero(inside & (own2 > 0) & (own2 >= least**2 * norm2) & (reach >= least * np.sqrt(norm2)))
    if not len(windows):
        return
    wanted = np.zeros(n_blocks + 1, bool)
    wanted[windows] = True
    near = wanted.copy()
    near[1:] |= wanted[:-1]
    hit = np.flatnonzero(known & np.repeat(near[:n_blocks], half))
    hit = hit[weight[term[hit]] > 0]
    block = hit // half
    a, z = wanted[block], (block > 0) & wanted[np.maximum(block - 1, 0)]
    win, t, v = sparse_windows(
        np.concatenate([term[hit[a]], term[hit[z]]]), weight, np.concatenate([block[a], block[z] - 1]), latent.shape[0]
    )
    v = v.astype(np.float32)
    step = max(1, (1 << 22) // max(1, latent.shape[1]))
    edges = np.flatnonzero(np.concatenate([[True], win[1:] != win[:-1]]))
    at = 0
    while at < len(win):  # whole windows at a time
        stop = edges[min(np.searchsorted(edges, at + step), len(edges) - 1)]
        stop = len(win) if stop <= at or at + step >= len(win) else stop
        w, s = sum_rows(win[at:stop], v[at:stop, None] * latent[t[at:stop]])
        cos = s / np.sqrt(norm2[w])[:, None]
        i, j = np.nonzero(cos >= cosine)
        rows = np.searchsorted(starts, w[i], side="right") - 1
        yield from zip(rows.tolist(), j.tolist(), w[i].tolist(), cos[i, j].tolist(), strict=True)
        at = stop


def leaked_ids(leaks: DataFrame) -> DataFrame:
    return leaks.select("doc_id", "text_md5").distinct()


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, columns as they were."""
    bad = leaked_ids(find_leaks(docs, benchmark, **options)).select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__m"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("__m", F.md5(text.cast("binary"))).alias("d")
    cond = (F.col("d.__m") == F.col("b.__m")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.__id"))
    return keyed.join(bad.alias("b"), cond, "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])
