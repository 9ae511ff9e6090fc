"""Operator 3, language-model scoring with an Elias-Fano n-gram trie.

The model is an interpolated n-gram model over words and one end mark per text:

    P(w)        = (c(w) + 1) / (N + V + 1)
    P(w | ctx)  = c(ctx w) / (c(ctx) + M) + M / (c(ctx) + M) * P(w | shorter ctx)

Counts come from all training texts. A level of the trie holds, for the n-grams of one
length, the contexts (Elias-Fano), monotone pointers to their successors (Elias-Fano), the
successor words made monotone by adding the last value of the range before (Elias-Fano),
and the smoothed first term of P(w | ctx) as a 16-bit code on a logarithmic scale. A
successor is looked for in the range of its context only.

At scale no machine holds the trie. N-grams are dealt over shards by the sum of their words'
hashes, so no context, however common, meets in one task. A shard's task builds its part
of the level, maps it from a file in its own folder that is unlinked at once, and answers
the distinct n-grams that each batch of documents asks for. Batches are bounded numbers of
tokens; what travels are sorted, delta-coded, compressed arrays per (batch, shard). Word ids
follow the counts and leave out what the shard tells, so the bytes of a request do not grow with
the number of shards; answers are written bucketed by batch and move once. A context that one
batch alone holds, held-out rows included, is continued there only: that batch counts its
n-grams itself and asks no shard. Of the others, a shard sends what the batch does not know
itself.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER_ASCII, materialise, text_bytes
from quire.llm.elias_fano import EliasFano
from quire.llm.words import groups, hash_words, mix
from quire.session import shared_path

ORDER = 3
MASS = 400.0  # M: words of prior mass from the shorter context
TOKENS_PER_BATCH = 3 << 18
TOKENS_PER_SHARD = 3 << 20
PLANES_APART = 1024  # values from which on byte planes are compressed one by one
MIN_SHARDS = 12
LEVELS = (1 << 16) - 1  # codes of the quantised probabilities; 0 means not in the level
# a level's requests and replies are stored or used up when its job ends: their shuffle files go then
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
END = 0  # hash of the end mark

_TABLE = bytes(32 if b in b" \t\n\v\f\r" else LOWER_ASCII[b] for b in range(256))


# --- arrays as bytes -----------------------------------------------------------------


def pack(a: np.ndarray, delta: bool = False) -> bytes:
    """Non-negative integers as bytes: differences if sorted, the least width, byte planes, zstd (long planes apart)."""
    a = np.asarray(a)
    if delta and len(a):
        a = np.diff(a, prepend=a.dtype.type(0))
    top = int(a.max()) if len(a) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    zstd = zstandard.ZstdCompressor(level=1)
    frames = [zstd.compress(p.tobytes()) for p in (planes if len(a) >= PLANES_APART else [planes])]
    return bytes([width, delta, len(frames)]) + b"".join(len(f).to_bytes(4, "little") + f for f in frames)


def unpack(raw: bytes) -> np.ndarray:
    """int64 values (uint64 of full width come back with the same bits)."""
    width, delta, frames = raw[:3]
    zstd, parts, at = zstandard.ZstdDecompressor(), [], 3
    for _ in range(frames):
        end = at + 4 + int.from_bytes(raw[at : at + 4], "little")
        parts.append(zstd.decompress(raw[at + 4 : end]))
        at = end
    planes = np.frombuffer(b"".join(parts), np.uint8).reshape(width, -1)
    a = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64).view(np.int64)
    return np.cumsum(a) if delta else a


def pack_grams(keys: np.ndarray, width: int, shards: int) -> bytes:
    """Sorted keys of one shard: contexts as differences, of the words what the shard does not tell.

    A key's shard is key mod ``shards``; ``width`` mod ``shards`` is 1, so context and shard give the word's remainder.
    """
    contexts = pack(keys // width, True)
    return len(contexts).to_bytes(4, "little") + contexts + pack(keys % width // shards)


def unpack_grams(raw: bytes, width: int, shards: int, shard: int) -> np.ndarray:
    n = 4 + int.from_bytes(raw[:4], "little")
    context = unpack(raw[4:n])
    return context * width + unpack(raw[n:]) * shards + (shard - context) % shards


# --- one level of the trie -------------------------------------------------------------


class Level:
    """The n-grams of one length in a shard, mapped from a file.

    Keys are context node * width + word id. ``find`` gives positions, ``value`` the decoded
    probabilities; both work on arrays that the operating system pages in.
    """

    def __init__(self, keys: np.ndarray, prob: np.ndarray, width: int, scale: tuple[float, float] | None = None):
        """``keys`` distinct and sorted, ``prob`` in (0, 1], ``width`` above every word id. ``scale``: the least
        logarithm and the step of the codes; the level's own range without it."""
        self.width, self.n = width, len(keys)
        context, word = keys // width, keys % width
        node, start = np.unique(context, return_index=True)
        pointer = np.append(start, len(keys))
        last = word[pointer[1:] - 1] if len(keys) else word
        base = np.concatenate([[0], np.cumsum(last + 1)])
        run = word + np.repeat(base[:-1], np.diff(pointer)) if len(keys) else word
        log = np.log10(prob) if len(prob) else np.zeros(0)
        if scale is None:
            low = float(log.min()) if len(log) else 0.0
            scale = low, max((float(log.max()) - low) / (LEVELS - 1), 1e-12) if len(log) else 1.0
        self.low, self.step = scale
        codes = encode(log, self.low, self.step)
        self.contexts = EliasFano.build(node, int(node[-1]) + 1 if len(node) else 1)
        self.pointers = EliasFano.build(pointer, len(keys) + 1)
        self.successors = EliasFano.build(run, int(base[-1]) + 1)
        self.codes = codes
        self._map()

    def _map(self) -> None:
        """Write all arrays to one file, map it, drop the file's name: nothing is left behind."""
        arrays = [(ef, f) for ef in (self.contexts, self.pointers, self.successors) for f in EliasFano.FIELDS]
        parts = [getattr(o, f) for o, f in arrays] + [self.codes]
        fd, path = tempfile.mkstemp(prefix="trie-")
        with os.fdopen(fd, "r+b") as file:
            os.unlink(path)
            at = []
            for p in parts:
                file.seek(-(-file.tell() // 8) * 8)
                at.append(file.tell())
                file.write(np.ascontiguousarray(p).data)
            file.truncate(max(file.tell(), 8))
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        views = [np.frombuffer(self.map, p.dtype, len(p), a) for p, a in zip(parts, at, strict=True)]
        for (o, f), view in zip(arrays, views, strict=False):
            setattr(o, f, view)
        self.codes = views[-1]

    def size(self) -> int:
        return len(self.map)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1. Keys in sorted order are fastest."""
        if not self.n or not len(keys):
            return np.full(len(keys), -1, np.int64)
        context, word = keys // self.width, keys % self.width
        node, inverse = np.unique(context, return_inverse=True)
        k = self.contexts.next_geq(node)
        here = k < self.contexts.n
        k = np.minimum(k, self.contexts.n - 1)
        here &= self.contexts.access(k) == node
        lo, hi = self.pointers.access(k), self.pointers.access(k + 1)
        # the base of a range follows the last value of the range before it
        base = np.where(lo > 0, self.successors.access(np.maximum(lo - 1, 0)) + 1, 0)
        want = word + base[inverse]
        at = self.successors.next_geq(want)
        ok = here[inverse] & (at < hi[inverse]) & (at >= lo[inverse])
        got = np.flatnonzero(ok)
        ok[got] = self.successors.access(at[got]) == want[got]
        return np.where(ok, at, -1)

    def code(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.codes[np.maximum(at, 0)], 0)


def encode(log: np.ndarray, low: float, step: float) -> np.ndarray:
    """16-bit codes of base-10 logarithms from ``low`` on; 0 is left for what is not in the level."""
    return (np.rint((log - low) / step) + 1).astype(np.uint16)


def scale_of(tokens: int, mass: float) -> tuple[float, float]:
    """(least logarithm, step) of the codes: c / (total + M) lies between 1 / (N + M) and 1, in every shard and batch."""
    low = -np.log10(tokens + mass)
    return float(low), max(float(-low / (LEVELS - 1)), 1e-12)


def decode(codes: np.ndarray, low: float, step: float) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (low + (codes.astype(np.float64) - 1) * step), 0.0)


def first_of(a: np.ndarray) -> np.ndarray:
    """Positions at which a sorted array changes."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


# --- batches of documents ----------------------------------------------------------------


_BATCH = "batch long, ids binary, held binary, tokens binary, vocabulary binary, lengths binary, n long"


def encode_batches(docs: DataFrame, held_out: Column, tokens_per_batch: int = TOKENS_PER_BATCH) -> DataFrame:
    """Documents as batches: ids, lengths, token numbers within the batch's own vocabulary of word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0

        def out(ids: list, held: list, hashes: list, lengths: list) -> pa.RecordBatch:
            nonlocal made
            vocabulary, tokens, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            common = np.argsort(-count, kind="stable")  # common words have small numbers, which pack well
            number = np.empty_like(common)
            number[common] = np.arange(len(common))
            vocabulary, tokens = vocabulary[common], number[tokens]
            known = np.array([i is not None for i in ids])
            id_bytes = np.array([0 if i is None else i for i in ids], np.int64).tobytes() + known.tobytes()
            row = [part << 32 | made, id_bytes, np.array(held, np.uint8).tobytes(), pack(tokens), vocabulary.tobytes(),
                   np.array(lengths, np.int64).tobytes(), len(tokens)]
            made += 1
            kinds = [pa.int64(), *[pa.binary()] * 5, pa.int64()]
            names = ["batch", "ids", "held", "tokens", "vocabulary", "lengths", "n"]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        ids, held, hashes, lengths, size = [], [], [], [], 0
        for b in batches:
            at = 0
            for run_ in groups(t.as_py() for t in b.column(2)):
                h, first = hash_words(run_, _TABLE)
                h[h == END] = 1
                n = np.diff(first)
                # an end mark after every text
                with_end = np.zeros(len(h) + len(run_), np.uint64)
                place = np.arange(len(h)) + np.repeat(np.arange(len(run_)), n)
                with_end[place] = h
                hashes.append(with_end)
                lengths += (n + 1).tolist()
                ids += b.column(0).slice(at, len(run_)).to_pylist()
                held += b.column(1).slice(at, len(run_)).to_pylist()
                at += len(run_)
                size += len(with_end)
                if size >= tokens_per_batch:
                    yield out(ids, held, hashes, lengths)
                    ids, held, hashes, lengths, size = [], [], [], [], 0
        if ids:
            yield out(ids, held, hashes, lengths)

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), text_bytes(F.col("text")).alias("t"))
    return cols.mapInArrow(run, _BATCH)


class Batch:
    """A batch with what the shards have answered so far, level by level."""

    def __init__(self, row: dict, shards: int):
        raw = row["ids"]
        n = len(raw) // 9
        self.ids = np.frombuffer(raw, np.int64, n)
        self.known = np.frombuffer(raw, bool, n, n * 8)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.tokens = unpack(row["tokens"])
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.shards = shards
        self.start = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(n), self.lengths)
        self.train = ~self.held[self.doc]
        self.place = np.arange(len(self.tokens)) - self.start[self.doc]

    def deal(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.shards)).astype(np.int64)

    def first(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Level 1: (shard, word hashes, training counts)."""
        count = np.bincount(self.tokens[self.train], minlength=len(self.vocabulary))
        shard = self.deal(self.vocabulary)
        for s in np.unique(shard):
            w = np.flatnonzero(shard == s)
            yield int(s), self.vocabulary[w], count[w]

    def words(self, replies: dict[int, dict]) -> None:
        """Take the answers of level 1: word ids (-1: not in training) and counts."""
        shard = self.deal(self.vocabulary)
        word, count = np.full(len(self.vocabulary), -1, np.int64), np.zeros(len(self.vocabulary), np.int64)
        shared = np.zeros(len(word), bool)
        for s, r in replies.items():
            w = np.flatnonzero(shard == s)
            rank, count[w], shared[w] = unpack(r["nodes"]) - 1, unpack(r["counts"]), unpack(r["codes"])
            word[w] = np.where(rank >= 0, rank * self.shards + s, -1)
        node = self.contexts(word, count, shared)
        self.word, self.count = word[self.tokens], count[self.tokens]
        end = np.flatnonzero(self.vocabulary == np.uint64(END))[0]
        self.end = int(node[end])
        self.end_count = int(count[end])
        # node and count of the one-word context before each token; the end mark stands before a text
        self.node, self.context_count = np.roll(node[self.tokens], 1), np.roll(self.count, 1)
        self.node[self.start], self.context_count[self.start] = self.end, self.end_count
        self.level = 2

    @staticmethod
    def contexts(node: np.ndarray, count: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Nodes as contexts: -1 not in training, under -1 the batch's own (no other batch holds it), else the shards'."""
        return np.where(count == 0, -1, np.where(shared, node, -2 - np.arange(len(node))))

    def grams(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys (context node, word) of the next level; token positions that have one, and which. Below 0: own contexts."""
        ok = np.flatnonzero((self.node != -1) & (self.word >= 0) & (self.place >= self.level - 2))
        keys, which = np.unique(self.node[ok] * width + self.word[ok], return_inverse=True)
        return keys, ok, which

    def ask(self, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(shard, keys sorted, training counts, training counts of the contexts)."""
        keys, ok, which = self.grams(width)
        count = np.bincount(which[self.train[ok]], minlength=len(keys))
        total = np.zeros(len(keys), np.int64)
        total[which] = self.context_count[ok]
        for s, w in self.dealt(keys):
            k = keys[w]
            yield s, k, count[w], total[w[first_of(k // width)]]  # keys of a context share its total

    def dealt(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, positions of its keys) of the keys that a shard must answer."""
        own = int(np.searchsorted(keys, 0))
        shard = keys[own:] % self.shards
        order = np.argsort(shard, kind="stable")
        for w in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(w):
                yield int(shard[w[0]]), w + own

    def answer(self, width: int, replies: dict[int, dict], mass: float, scale: tuple[float, float], p: np.ndarray) -> np.ndarray:
        """Interpolate the next level over ``p``; then step to longer contexts.

        What the batch counts itself takes the same codes as in the trie, so scores do not depend
        on how documents fall into batches.
        """
        keys, ok, which = self.grams(width)
        here = np.bincount(which[self.train[ok]], minlength=len(keys))
        total = np.zeros(len(keys), np.int64)
        total[which] = self.context_count[ok]
        # right for n-grams that train in this batch alone; the shards have those that train in others too
        seen = np.flatnonzero(here)
        codes = np.zeros(len(keys), np.uint16)
        codes[seen] = encode(np.log10(here[seen] / (total[seen] + mass)), *scale)
        own, node, count, shared = decode(codes, *scale), np.full(len(keys), -1, np.int64), here.copy(), np.zeros(len(keys), bool)
        for s, w in self.dealt(keys):
            r = replies[s]
            others = unpack(r["counts"]) - 1  # -1: no other batch holds it
            own[w[others > 0]] = decode(unpack(r["codes"]), r["low"], r["step"])
            if r["nodes"] is not None:
                count[w] += np.maximum(others, 0)
                shared[w] = others >= 0
                node[w[shared[w] & (count[w] > 0)]] = unpack(r["nodes"]) * self.shards + s
        node = self.contexts(node, count, shared)
        seen = np.where(self.place >= self.level - 2, self.context_count, 0)
        out = mass / (seen + mass) * p
        out[ok] += own[which]
        grown, grown_count = np.full(len(self.word), -1, np.int64), np.zeros(len(self.word), np.int64)
        grown[ok], grown_count[ok] = node[which], count[which]
        # the gram that ends at a token is the context of the token after it
        self.node, self.context_count = np.roll(grown, 1), np.roll(grown_count, 1)
        self.node[self.start], self.context_count[self.start] = -1, 0
        self.level += 1
        return out


# --- shards -------------------------------------------------------------------------------


_ASKED = "shard int, batch long, keys binary, counts binary, totals binary"
_REPLY = "shard int, batch long, level int, nodes binary, counts binary, codes binary, low double, step double, types long, tokens long"


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one shard at a time from a stream sorted by shard."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["shard"] != now and rows:
                yield now, rows
                rows = []
            now = r["shard"]
            rows.append(r)
    if rows:
        yield now, rows


def _reply_row(**values) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "batch": pa.int64(), "level": pa.int32(), "nodes": pa.binary(), "counts": pa.binary(),
             "codes": pa.binary(), "low": pa.float64(), "step": pa.float64(), "types": pa.int64(), "tokens": pa.int64()}
    return pa.record_batch([pa.array([values.get(k)], t) for k, t in kinds.items()], names=list(kinds))


def answer_words(asked: DataFrame, shards: int) -> DataFrame:
    """Level 1 of every shard: word ids (rank * shards + shard, so ids are unique without a global pass) and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
            every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate([unpack(r["counts"]) for r in rows]), minlength=len(every)).astype(np.int64)
            rank = np.empty(len(every), np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(every))  # small ids for common words: keys of n-grams pack well
            node = np.where(count > 0, rank + 1, 0)  # 0: not in training; the batch knows the shard
            shared = np.bincount(inverse, minlength=len(every)) > 1  # held by several batches
            at = 0
            for r, k in zip(rows, keys, strict=True):
                w = inverse[at : at + len(k)]
                at += len(k)
                yield _reply_row(shard=shard, batch=r["batch"], level=1, nodes=pack(node[w]), counts=pack(count[w]), codes=pack(shared[w]),
                                 types=int((count > 0).sum()), tokens=int(count.sum()))

    return asked.repartition(shards, "shard").sortWithinPartitions("shard", "batch").mapInArrow(run, _REPLY)


def answer_grams(asked: DataFrame, shards: int, level: int, width: int, mass: float, tokens: int, last: bool) -> DataFrame:
    """One level of every shard: build the trie from the training counts, answer all that was asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            keys = [unpack_grams(r["keys"], width, shards, shard) for r in rows]
            every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate([unpack(r["counts"]) for r in rows]), minlength=len(every)).astype(np.int64)
            total = np.zeros(len(every), np.int64)
            at = 0
            for r, k in zip(rows, keys, strict=True):
                first = first_of(k // width)
                total[inverse[at : at + len(k)]] = np.repeat(unpack(r["totals"]), np.diff(np.append(first, len(k))))
                at += len(k)
            seen = np.flatnonzero(count > 0)
            trie = Level(every[seen], count[seen] / (total[seen] + mass), width, scale_of(tokens, mass))
            at_all = trie.find(every)
            codes = trie.code(at_all)
            shared = np.bincount(inverse, minlength=len(every)) > 1  # held by several batches
            at = 0
            for r, k in zip(rows, keys, strict=True):
                w = inverse[at : at + len(k)]
                at += len(k)
                others = count[w] - unpack(r["counts"])
                if last:  # no context: that others train it is enough
                    more = {"counts": pack(2 * (others > 0))}
                else:  # nodes in the order of the keys, which is that of the trie
                    more = {"counts": pack(np.where(shared[w], others + 1, 0)), "nodes": pack(at_all[w[shared[w] & (count[w] > 0)]], True)}
                yield _reply_row(shard=shard, batch=r["batch"], level=level, codes=pack(codes[w[others > 0]]), low=trie.low, step=trie.step,
                                 types=trie.n, tokens=trie.size(), **more)

    return asked.repartition(shards, "shard").sortWithinPartitions("shard", "batch").mapInArrow(run, _REPLY)


def _replayed(left: pa.Table, right: pa.Table, shards: int, width: int, upto: int, mass: float, n: int, v: int) -> tuple[Batch, np.ndarray]:
    """The batch with the answers of all levels below ``upto`` taken in, and the probabilities so far."""
    batch = Batch(left.to_pylist()[0], shards)
    replies: dict[int, dict[int, dict]] = {}
    for r in right.to_pylist():
        replies.setdefault(r["level"], {})[r["shard"]] = r
    batch.words(replies[1])
    p = (batch.count + 1.0) / (n + v + 1.0)
    batch.base = np.log10(p)
    for level in range(2, upto):
        p = batch.answer(width, replies.get(level, {}), mass, scale_of(n, mass), p)
    return batch, p


def score_texts(docs: DataFrame, held_out: Column, order: int = ORDER, mass: float = MASS, tokens_per_batch: int = TOKENS_PER_BATCH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    ``held_out`` marks the rows that do not train. Words are told apart by 64-bit hashes.
    Null and empty texts have one token, the end mark. Null doc_ids stay null. Repeated rows
    train as often as they occur and score alike. A table without training rows: counts of
    0 and N = V = 0 (score log10(1) = 0 per token). Empty table: no rows. Other columns are
    not read. Texts are read once; nothing depends on how many partitions the table has or how
    documents fall into batches.
    """
    if order < 1:
        raise ValueError("the order is 1 or more")
    spark = docs.sparkSession
    name = f"quire_lm_{uuid.uuid4().hex[:12]}"
    # bucketed by batch: the joins of batches with the shards' answers move neither
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bucketed(df: DataFrame, kind: str, path: str) -> DataFrame:
        df.write.mode("append").bucketBy(buckets, "batch").option("path", path).saveAsTable(f"{name}_{kind}")
        return spark.table(f"{name}_{kind}")

    answers = shared_path(spark, "lm-answers")
    was = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        batches = bucketed(encode_batches(docs, held_out, tokens_per_batch), "batches", shared_path(spark, "lm-batches"))
        # a level's answers go to their batches once and join those of the levels before
        return _score(batches, order, mass, lambda df: bucketed(df.repartition(buckets, "batch"), "answers", answers))
    finally:
        spark.conf.set(FREE_SHUFFLES, was)
        for kind in ("batches", "answers"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{kind}")


def _score(batches: DataFrame, order: int, mass: float, by_batch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    tokens = batches.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(MIN_SHARDS, -(-tokens // TOKENS_PER_SHARD))

    def send_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for r in b.to_pylist():
                batch = Batch(r, shards)
                for s, keys, counts in batch.first():
                    yield _asked(s, r["batch"], keys.tobytes(), pack(counts), None)

    replies = by_batch(answer_words(batches.mapInArrow(send_words, _ASKED), shards))
    seen = replies.groupBy("shard").agg(F.max("types").alias("types"), F.max("tokens").alias("tokens"))
    stats = seen.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("types"), F.lit(0))).first()
    v, n, widest = (int(x) for x in stats)
    width = (widest + 1) * shards + 1  # above every word id; 1 mod shards, see pack_grams

    def sender(level: int):
        def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            schema = _asked(0, 0, b"", b"", b"").schema
            if not left.num_rows:
                return pa.Table.from_batches([], schema=schema)
            batch, _ = _replayed(left, right, shards, width, level, mass, n, v)
            rows = [_asked(s, key[0].as_py(), pack_grams(k, width, shards), pack(c), pack(t)) for s, k, c, t in batch.ask(width)]
            return pa.Table.from_batches(rows, schema=schema)

        return send

    for level in range(2, order + 1):
        if width * max(tokens, width) >= 1 << 62:
            raise ValueError("node and word ids of this corpus do not fit 62 bits: lower the order")
        asked = batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(sender(level), _ASKED)
        replies = by_batch(answer_grams(asked, shards, level, width, mass, n, level == order))

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not left.num_rows:
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.table([pa.array([], k) for k in kinds], names=names)
        batch, p = _replayed(left, right, shards, width, order + 1, mass, n, v)
        known = np.add.reduceat((batch.count > 0).astype(np.int64), batch.start)
        base, score = np.add.reduceat(batch.base, batch.start), np.add.reduceat(np.log10(p), batch.start)
        return pa.table(
            [pa.array(batch.ids, mask=~batch.known), pa.array(batch.held), pa.array(batch.lengths), pa.array(known),
             pa.array(np.full(len(known), n)), pa.array(base), pa.array(score)], names=names)

    scores = batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return materialise(scores, "lm-scores")  # the tables of batches and answers go when this function ends


def _asked(shard: int, batch: int, keys: bytes, counts: bytes, totals: bytes | None) -> pa.RecordBatch:
    values = {"shard": pa.array([shard], pa.int32()), "batch": pa.array([batch], pa.int64()), "keys": pa.array([keys], pa.binary()),
              "counts": pa.array([counts], pa.binary()), "totals": pa.array([totals], pa.binary())}
    return pa.record_batch(list(values.values()), names=list(values))
