"""Sub-word unigram vocabulary (E6) and sub-word encoding (F1, sub-word path).

Training is expectation-maximisation over the distinct-word table, with the scores in a table:

* seeds: the maximal repeated sub-strings of ``▁word`` by sorted suffixes
  (:mod:`quire.operators.suffixes`), the ``seed_size`` best by frequency x length, plus every
  character of the alphabet (characters are never pruned);
* the scores of a round are a broadcast of keys and scores (``seed_size`` and the alphabet bound it);
* E-step: a task goes through its words, and array operations run forward-backward over the
  lattices of many words of one length at once; expected counts are summed in the task;
* M-step: the sums per piece over their total are the new scores, a written table;
* pruning, by the shrink factor until the requested size is reached, keeps the pieces without
  which the likelihood loses most: losses are computed like the E-step, over pieces in place of
  words, and the cut is a two-phase rank.

Single numbers (a total, row counts) come to the driver, and per round the key and score of every
piece left, whose number the parameters bound. Pieces are keyed by a 64-bit hash of their
characters inside the training loop. Encoding is a Viterbi best path per distinct word of an
Arrow batch, with byte fallback for characters outside the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import options
from quire.functions import text as T
from quire.operators import encode as E
from quire.operators import offsets as O
from quire.operators import suffixes as S
from quire.operators import vocab as V
from quire.session import stored

MAX_PIECES_BROADCAST = 2_000_000
MEMO_WORDS = 1_000_000  # segmented words a task remembers
UNK_PENALTY = 10.0
WORDS_PER_FILE = 200_000
ROWS_OUT = 1 << 16
CELLS = 1 << 19  # lattice edges that are worked on at once

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _lattice(word: str, scores: dict[str, float], max_len: int, unk: float):
    n = len(word)
    edges = [[] for _ in range(n + 1)]  # edges[end] = (start, piece, logp)
    for i in range(n):
        hit = False
        for j in range(i + 1, min(n, i + max_len) + 1):
            p = word[i:j]
            s = scores.get(p)
            if s is not None:
                edges[j].append((i, p, s))
                if j == i + 1:
                    hit = True
        if not hit:  # a character outside the table: one unknown edge
            edges[i + 1].append((i, None, unk))
    return edges


# --------------------------------------------------------------------------- many words at once


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def piece_keys(words: list[str], max_len: int) -> Iterator[np.ndarray]:
    """Keys (starts x words) of all sub-strings of words of one length, for lengths 1, 2 and so on.

    A key is a polynomial hash of the mixed characters, mixed with the length.
    """
    n = len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n)
    value = _mixed(codes.T.astype(np.uint64) + _ODD)
    run = np.zeros(value.shape, np.uint64)
    for l in range(1, min(max_len, n) + 1):
        run = run[: n - l + 1] * _ODD + value[l - 1 :]
        key = _mixed(run ^ _mixed(np.full(1, l, np.uint64)))
        yield np.where(key == 0, np.uint64(1), key)


def key_of(pieces: list[str]) -> np.ndarray:
    """The key of every piece, as signed longs."""
    out = np.zeros(len(pieces), np.uint64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    for n in np.unique(lengths[lengths > 0]):
        of = np.flatnonzero(lengths == n)
        *_, whole = piece_keys([pieces[k] for k in of], int(n))
        out[of] = whole[0]
    return out.view(np.int64)


class Places:
    """Places of keys in a sorted array of them, by their leading bits: keys are hashes, so few share these."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        bits = max(1, self.n.bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(keys, np.uint64(2**64 - 1))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of every key or of the next one, whether it is there)."""
        at = self.first[(keys >> self.shift).astype(np.int64)]
        below = np.flatnonzero(self.keys[at] < keys)
        while len(below):
            at[below] += 1
            below = below[self.keys[at[below]] < keys[below]]
        return at, (self.keys[at] == keys) & (at < self.n)


class Lattices:
    """The lattices of words of one length: edges by start and length, with scores and places in the key table.

    Arrays are kept as lengths x starts x words, so that every step goes over words that lie side by side.
    """

    def __init__(self, words: list[str], keys: np.ndarray | Places, scores: np.ndarray, max_len: int, unk: float, whole: bool = True):
        """``keys`` is sorted. Without ``whole`` a word's own piece is no edge."""
        table = keys if isinstance(keys, Places) else Places(keys)
        n = len(words[0])
        shape = (min(max_len, n), n, len(words))
        self._known, self._at, self._scores = np.zeros(shape, bool), np.zeros(shape, np.int32), np.full(shape, -np.inf)
        for l, found in enumerate(piece_keys(words, max_len), 1):
            at, known = table.find(found.ravel())
            if l == n and not whole:
                known[:] = False
            at[~known] = 0
            starts, kind = n - l + 1, found.shape
            self._known[l - 1, :starts], self._at[l - 1, :starts] = known.reshape(kind), at.reshape(kind)
            if table.n:
                self._scores[l - 1, :starts] = np.where(known, scores[at], -np.inf).reshape(kind)
        self._scores[0] = np.where(self._known[0], self._scores[0], unk)
        self.known = self._known.T

    def _forward(self, join: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        most, n, b = self._scores.shape
        alpha = np.zeros((n + 1, b))
        for j in range(1, n + 1):
            l = np.arange(min(most, j))
            alpha[j] = join(alpha[j - 1 - l] + self._scores[l, j - 1 - l])
        return alpha

    def best(self) -> np.ndarray:
        """Score of the best path of every word."""
        return self._forward(lambda t: t.max(axis=0))[-1]

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        most, n, b = self._scores.shape
        alpha = self._forward(_log_sum)
        beta = np.zeros((n + 1, b))
        for i in range(n - 1, -1, -1):
            m = min(most, n - i)
            beta[i] = _log_sum(beta[i + 1 : i + 1 + m] + self._scores[:m, i])
        z = alpha[n]
        p = np.zeros(self._scores.shape)
        for l in range(1, most + 1):
            np.exp(alpha[: n - l + 1] + self._scores[l - 1, : n - l + 1] + beta[l:] - z, out=p[l - 1, : n - l + 1])
        return z, p

    def expected(self) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of every word, probability that a path takes an edge: words x starts x lengths)."""
        z, p = self._edges()
        return z, p.T

    def counted(self, counts: np.ndarray, n_keys: int) -> tuple[float, np.ndarray]:
        """(log-likelihood of words that stand ``counts`` times, expected count of every key)."""
        z, p = self._edges()
        p *= counts
        return float(counts @ z), np.bincount(self._at[self._known], p[self._known], n_keys)


def _log_sum(terms: np.ndarray) -> np.ndarray:
    most = terms.max(axis=0)  # finite: one character always is an edge
    return most + np.log(np.exp(terms - most).sum(axis=0))


def by_length(words: list[str], max_len: int) -> Iterator[np.ndarray]:
    """Places of words of one length, as many at a time as CELLS allows."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths[lengths > 0]):
        of = np.flatnonzero(lengths == n)
        step = max(1, CELLS // int(n * min(n, max_len)))
        yield from (of[k : k + step] for k in range(0, len(of), step))


# --------------------------------------------------------------------------- tables of the training loop


class Model:
    """The scores of a round's pieces as a broadcast: keys sorted, and their scores.

    Their number is bounded by ``seed_size`` and the alphabet (16 bytes a piece), whatever the number of words,
    so no word has to be shuffled to the scores it needs.
    """

    def __init__(self, scores: DataFrame):
        held = scores.select("key", "score").toArrow()
        keys, values = held.column("key").to_numpy().astype(np.int64).view(np.uint64), held.column("score").to_numpy().astype(np.float64)
        order = np.argsort(keys)
        self.n, self.least = len(keys), float(values.min()) if len(keys) else 0.0
        self.held = scores.sparkSession.sparkContext.broadcast((keys[order], values[order]))

    def __enter__(self) -> Model:
        return self

    def __exit__(self, *_) -> None:
        self.held.destroy()


def _expected_counts(words: DataFrame, model: Model, max_len: int) -> DataFrame:
    """(key, e): expected counts of pieces; the log-likelihood has a null key. ``words``: w, cnt.

    A task goes through its words batch by batch and gives one row per piece that they hold.
    """
    held, unk = model.held, model.least - UNK_PENALTY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = held.value
        places, sums, total = Places(keys), np.zeros(len(keys)), 0.0
        for b in batches:
            texts, counts = b.column("w").to_pylist(), b.column("cnt").to_numpy().astype(np.float64)
            for of in by_length(texts, max_len):
                z, e = Lattices([texts[i] for i in of], places, values, max_len, unk).counted(counts[of], len(keys))
                total += z
                sums += e
        some = np.flatnonzero(sums)
        made = pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array(keys[some].view(np.int64)), pa.nulls(1, pa.int64())]),
            pa.array(np.append(sums[some], total)),
        ], names=["key", "e"])
        yield from (made.slice(k, ROWS_OUT) for k in range(0, made.num_rows, ROWS_OUT))

    return words.select("w", "cnt").mapInArrow(run, "key long, e double").groupBy("key").agg(F.sum("e").alias("e"))


def _losses(pieces: DataFrame, model: Model, max_len: int) -> DataFrame:
    """(piece, loss) of ``pieces`` (piece, score, e): what the likelihood loses without a piece, its expected
    count times the score it has over the best path through other pieces."""
    held, unk = model.held, model.least - UNK_PENALTY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = held.value
        places = Places(keys)
        for b in batches:
            texts, count, score = b.column("piece").to_pylist(), b.column("e").to_numpy(), b.column("score").to_numpy()
            best = np.zeros(len(texts))
            for of in by_length(texts, max_len):
                best[of] = Lattices([texts[i] for i in of], places, values, max_len, unk, whole=False).best()
            yield pa.RecordBatch.from_arrays([b.column("piece"), pa.array(count * (score - best))], names=["piece", "loss"])

    return pieces.select("piece", "score", "e").mapInArrow(run, "piece string, loss double")


def _keyed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("key", pa.array(key_of(b.column("piece").to_pylist()), pa.int64()))

    return pieces.mapInArrow(run, "piece string, score double, is_char boolean, key long")


def unigram_pieces(
    words: DataFrame,
    vocab_size: int,
    *,
    seed_size: int = 1_000_000,
    max_len: int = 16,
    shrink: float = 0.75,
    sub_iterations: int = 2,
    coverage: float = 0.9995,
    history: list | None = None,
) -> DataFrame:
    """(piece, score, is_char) of the learned pieces, a written table of ``vocab_size`` rows when the seeds
    allow it (characters always kept). ``words``: word, cnt, words unique. ``history`` takes the
    (number of pieces, log-likelihood) of every E-step."""
    spark = words.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    table = words.select(F.concat(F.lit(T.WORD_BOUNDARY), F.col("word")).alias("w"), "cnt")
    # words of one length lie together: the lattices of a batch are few and large
    dealt = table.repartition(max(least, -(-words.count() // WORDS_PER_FILE)), "w")
    table = stored(dealt.sortWithinPartitions(F.length("w")), "unigram-words")
    chars = V.alphabet_from_counts(V.weighted_char_counts(table), coverage).select(F.col("ch").alias("piece"))
    seeds = S.repeats(stored(S.intervals(table.select(F.col("w").alias("word"), "cnt"), max_len), "intervals"))
    seeds = stored(seeds.withColumn("worth", F.col("freq") * F.length("piece")), "unigram-repeats")
    n_seeds = seeds.count()
    if n_seeds > seed_size:
        seeds = _cut(seeds, "worth", seed_size, n_seeds)
    total = float(seeds.agg(F.sum("freq")).first()[0] or 1)
    # a character has one place's share; it may be a seed of no length but one, so the two sets are apart
    first = seeds.select("piece", F.log(F.col("freq") / F.lit(total)).alias("score"), F.lit(False).alias("is_char"))
    first = first.unionByName(chars.select("piece", F.lit(math.log(1.0 / total)).alias("score"), F.lit(True).alias("is_char")))
    scores = stored(_keyed(first), "unigram-scores")
    n_chars = scores.where("is_char").count()
    while True:
        for _ in range(sub_iterations):
            with Model(scores) as model:
                if not (n := model.n):
                    return scores.select("piece", "score", "is_char")
                counts = stored(_expected_counts(table, model, max_len), "unigram-counts")
            sum_, fit = counts.agg(F.sum(F.when(F.col("key").isNotNull(), F.col("e"))), F.max(F.when(F.col("key").isNull(), F.col("e")))).first()
            if history is not None:
                history.append((n, fit))
            by_piece = counts.where("key is not null")
            share = F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(1e-12)) / F.lit(sum_ or 1.0)
            scores = stored(
                scores.select("piece", "is_char", "key").join(by_piece, "key", "left").select("piece", F.log(share).alias("score"), "is_char", "key", F.coalesce("e", F.lit(0.0)).alias("e")),
                "unigram-scores",
            )
        if n <= vocab_size:
            return scores.select("piece", "score", "is_char")
        room = max(vocab_size, int(n * shrink))
        rest = scores.where("not is_char")
        with Model(scores) as model:
            losses = stored(_losses(rest, model, max_len), "unigram-losses")
        kept = _cut(losses, "loss", max(0, room - n_chars), n - n_chars).select("piece")
        scores = stored(scores.where("is_char").unionByName(rest.join(kept, "piece", "left_semi")), "unigram-scores")


def _cut(rows: DataFrame, value: str, n: int, n_rows: int) -> DataFrame:
    """The ``n`` rows of largest ``value`` (ties: smaller piece), by a two-phase rank. ``rows`` is a written table."""
    if n >= n_rows:
        return rows
    falling = rows.withColumn("falling", -F.col(value))
    ranked = O.global_positions(falling, ["falling", "piece"], O.quantile_bucketing(falling, "falling", n_rows), out="rank")
    return ranked.where(F.col("rank") < n).drop("falling", "rank")


def train_unigram(
    spark: SparkSession,
    texts: DataFrame,
    vocab_size: int,
    *,
    seed_size: int = 1_000_000,
    max_len: int = 16,
    shrink: float = 0.75,
    sub_iterations: int = 2,
    coverage: float = 0.9995,
    text_col: str = "text",
    history: list | None = None,
) -> list[tuple[str, float]]:
    """Learned pieces ``[(piece, log_prob)]``, most probable first, exactly
    ``vocab_size`` long when the seeds allow it (characters always kept)."""
    V.TrainingOptions(max(vocab_size, V.SMALLEST_VOCABULARY), coverage, "unigram")
    words = stored(V.word_counts(texts, text_col).where(~F.col("word").isin(*T.USER_DEFINED)), "words")
    learned = unigram_pieces(words, vocab_size, seed_size=seed_size, max_len=max_len, shrink=shrink,
                             sub_iterations=sub_iterations, coverage=coverage, history=history)
    # the learned table is as large as the vocabulary (or the alphabet, of at most all code points)
    rows = learned.limit(max(vocab_size, 0x110000) + 1).collect()
    options.check(pieces=(len(rows), options.Rule(lambda n: n <= MAX_PIECES_BROADCAST, f"up to {MAX_PIECES_BROADCAST}")))
    return sorted(((r["piece"], r["score"]) for r in rows), key=lambda kv: (-kv[1], kv[0]))


def unigram_piece_table(spark: SparkSession, learned: list[tuple[str, float]]) -> DataFrame:
    rows = [(V.FIRST_ID + i, p, float(s)) for i, (p, s) in enumerate(learned)]
    body = spark.createDataFrame(rows, "id int, piece string, score double")
    return V.piece_table(spark, body, F.col("score"))


def _viterbi(word: str, scores: dict[str, float], ids: dict[str, int], max_len: int, unk: float) -> list[int]:
    edges = _lattice(word, scores, max_len, unk)
    n = len(word)
    best = [-math.inf] * (n + 1)
    back: list = [None] * (n + 1)
    best[0] = 0.0
    for j in range(1, n + 1):
        for i, p, s in edges[j]:
            v = best[i] + s
            if v > best[j]:
                best[j], back[j] = v, (i, p)
    out: list[list[int]] = []
    j = n
    while j > 0:
        i, p = back[j]
        if p is None:
            out.append([T.BYTE_BASE + b for b in word[i:j].encode("utf-8")])
        else:
            out.append([ids[p]])
        j = i
    return [t for part in reversed(out) for t in part]


def encode_subword(df: DataFrame, learned: list[tuple[str, float]], *, id_col: str = "doc_id", text_col: str = "text",
                   max_len: int = 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sub-word encode (F1): whitespace words, ``▁`` prefix, Viterbi best path by
    piece score, user-defined symbols as their ids, byte fallback for unknown
    characters. Rows without words are dropped (B2).

    The distinct words of an Arrow batch are segmented once (and remembered in a bounded
    memo), not every occurrence. ``keep`` columns pass through, so a loader can use it.
    """
    options.check(pieces=(len(learned), options.Rule(lambda n: n <= MAX_PIECES_BROADCAST, f"up to {MAX_PIECES_BROADCAST}")))
    table = df.sparkSession.sparkContext.broadcast(
        (dict(learned), {p: V.FIRST_ID + i for i, (p, _) in enumerate(learned)})
    )
    special = {p: [i] for i, p, _ in T.SPECIAL_PIECES if p in T.USER_DEFINED}
    unk = (min(s for _, s in learned) if learned else 0.0) - UNK_PENALTY

    def pieces_of():
        scores, ids = table.value
        memo = dict(special)

        def find(word: str) -> list[int]:
            if (got := memo.get(word)) is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                    memo.update(special)
                got = memo[word] = _viterbi(T.WORD_BOUNDARY + word, scores, ids, max_len, unk)
            return got

        return find

    return E.map_words(df, (id_col, *keep), T.words(F.col(text_col)), pieces_of)
