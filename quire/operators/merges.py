"""Pair-merge vocabularies (E5) in exact batches of many merges per pass, and their encoder (F1).

The plain trainer merges the most frequent adjacent pair, counts all pairs again, and so on: a
pass over the words for every merge. Here a pass serves a whole batch:

1. all pairs are counted in Spark, and the best ``k`` of them, those of more than ``floor``
   places, are *active*; every other pair has at most ``floor``;
2. a word is cut wherever two neighbours are no active pair. A merge joins pieces only inside
   what remains, and a new pair that spans a cut has no more places than the pair at the cut,
   so at most ``floor``. Equal fragments of all words are summed in Spark; there are few of
   them, their number is bounded, and ``k`` falls until they are within the bound;
3. on the fragments, with an index from pairs to fragments, merges are taken one by one with
   their exact counts, as long as the best pair has more than ``floor`` places;
4. the batch is applied to the words in one more pass, and the next batch begins.

A merge whose piece exists already (``ab`` + ``c`` after ``a`` + ``bc``) ends its batch: its pairs
have places outside the fragments. The result is the plain trainer's, merge by merge, ties
included. Driver and tasks hold ``k`` pairs, the bounded fragments and the merges, not the words.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import encode as E

MAX_FRAGMENTS = 200_000  # distinct fragments that reach the driver
FIRST_PAIRS = 64  # active pairs of the first batch; later ones follow the fragments' number
MAX_PAIRS = 8192
HELD = 200_000  # distinct keys a task sums before it passes them on
MEMO_WORDS = 1_000_000

Pair = tuple[str, str]
Merge = tuple[int, str, str, int]


def word_symbols(words: DataFrame) -> DataFrame:
    """(s, freq): the characters of ``▁word`` joined by blanks, which no word holds. ``words``: word, cnt."""
    s = F.array_join(T.chars(F.concat(F.lit(T.WORD_BOUNDARY), F.col("word"))), " ")
    return words.select(s.alias("s"), F.col("cnt").cast("long").alias("freq"))


def _summed(table: DataFrame, keys_of: Callable[[list[str]], Iterator[str]]) -> DataFrame:
    """(key, n): keys of every word's symbols weighted by its frequency, summed in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["key", "n"])
            held.clear()
            return made

        for b in batches:
            for s, freq in zip(b.column("s").to_pylist(), b.column("freq").to_pylist()):
                for key in keys_of(s.split(" ")):
                    held[key] += freq
                if len(held) >= HELD:
                    yield out()
        yield out()

    return table.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def symbol_pairs(table: DataFrame) -> DataFrame:
    """(l, r, cnt): adjacent symbols weighted by word frequency."""
    keys = _summed(table, lambda y: map(" ".join, zip(y, y[1:])))
    side = F.split("key", " ")
    return keys.select(side[0].alias("l"), side[1].alias("r"), F.col("n").alias("cnt"))


def _fragments(table: DataFrame, active: set[Pair]) -> DataFrame:
    held = table.sparkSession.sparkContext.broadcast(active)

    def cut(y: list[str]) -> Iterator[str]:
        pairs, begin = held.value, 0
        for k in range(1, len(y) + 1):
            if k == len(y) or (y[k - 1], y[k]) not in pairs:
                if k - begin > 1:
                    yield " ".join(y[begin:k])
                begin = k

    return _summed(table, cut)


def merged(y: list[str], left: str, right: str) -> list[str]:
    """The symbols with every (left, right) joined, from left to right."""
    out, k = [], 0
    while k < len(y):
        if k + 1 < len(y) and y[k] == left and y[k + 1] == right:
            out.append(left + right)
            k += 2
        else:
            out.append(y[k])
            k += 1
    return out


def merge_fragments(fragments: list[tuple[list[str], int]], floor: int, most: int, known: set[str]) -> list[tuple[str, str, int]]:
    """Up to ``most`` merges (left, right, places) in order, while the best pair has more than ``floor`` places.

    ``known`` holds the pieces that exist and takes the new ones.
    """
    counts: Counter = Counter()
    where: dict[Pair, set[int]] = defaultdict(set)
    words = [y for y, _ in fragments]
    for k, (y, n) in enumerate(fragments):
        for p in zip(y, y[1:]):
            counts[p] += n
            where[p].add(k)
    heap = [(-n, *p) for p, n in counts.items()]
    heapq.heapify(heap)
    out: list[tuple[str, str, int]] = []
    while heap and len(out) < most:
        minus, left, right = heapq.heappop(heap)
        if counts[left, right] != -minus:
            continue  # an entry of the past
        if -minus <= floor:
            break
        out.append((left, right, -minus))
        touched = set()
        for k in where.pop((left, right)):
            y, n = words[k], fragments[k][1]
            new = merged(y, left, right)
            if len(new) == len(y):
                continue
            for p in zip(y, y[1:]):
                counts[p] -= n
                touched.add(p)
            for p in zip(new, new[1:]):
                counts[p] += n
                where[p].add(k)
                touched.add(p)
            words[k] = new
        for p in touched:
            if counts[p] > floor:
                heapq.heappush(heap, (-counts[p], *p))
        if left + right in known:
            break
        known.add(left + right)
    return out


def _apply(table: DataFrame, batch: list[tuple[str, str, int]]) -> DataFrame:
    held = table.sparkSession.sparkContext.broadcast({(a, b): k for k, (a, b, _) in enumerate(batch)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held.value
        for b in batches:
            out = []
            for s in b.column("s").to_pylist():
                y, done = s.split(" "), -1
                while True:
                    best = min((r for p in zip(y, y[1:]) if (r := ranks.get(p, -1)) > done), default=None)
                    if best is None:
                        break
                    y, done = merged(y, *batch_pairs[best]), best
                out.append(" ".join(y))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column("freq")], names=["s", "freq"])

    batch_pairs = [(a, b) for a, b, _ in batch]
    return table.mapInArrow(run, "s string, freq long")


def train_merges(words: DataFrame, n_merges: int, store: Callable[[DataFrame, str], DataFrame], *, max_fragments: int = MAX_FRAGMENTS) -> list[Merge]:
    """The first ``n_merges`` merges (index, left, right, places) of ``words`` (word, cnt; words unique).

    The best pair has the most places; ties go to the smaller left, then right symbol. ``store``
    writes a table and reads it back: words are written once per batch, so no lineage grows.
    """
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.sparkSession.sparkContext.defaultParallelism)
    table = store(word_symbols(words).where(F.length("s") > 0).repartition(parts, "s"), "merge-words")
    merges: list[Merge] = []
    known: set[str] = set()
    k = FIRST_PAIRS
    while len(merges) < n_merges:
        top = symbol_pairs(table).orderBy(F.desc("cnt"), "l", "r").limit(k + 1).collect()
        if not top:
            break
        batch: list[tuple[str, str, int]] = []
        while not batch:
            floor = top[k]["cnt"] if len(top) > k else 0
            active = {(r["l"], r["r"]) for r in top[:k] if r["cnt"] > floor}
            rows = _fragments(table, active).limit(max_fragments + 1).collect() if active else []
            if active and len(rows) <= max_fragments:
                batch = merge_fragments([(r["key"].split(" "), r["n"]) for r in rows], floor, n_merges - len(merges), known)
                if len(rows) < max_fragments // 4:
                    k = min(2 * k, MAX_PAIRS)
            elif active and k > 1:
                k //= 2
            else:  # the best pairs are all alike, or one alone has too many fragments: the first is certain
                batch = [(top[0]["l"], top[0]["r"], top[0]["cnt"])]
                known.add(top[0]["l"] + top[0]["r"])
                k = min(2 * k, MAX_PAIRS)
        merges += [(len(merges) + i, *m) for i, m in enumerate(batch)]
        if len(merges) < n_merges:
            table = store(_apply(table, batch), "merge-words")
    return merges


# --------------------------------------------------------------------------- encoding (F1)


def split_word(word: str, ranks: dict[str, float]) -> list[str]:
    """The pieces of a word: neighbours whose piece has the least rank are joined, the left ones first, until none is known."""
    y: list[str | None] = list(word)
    after, before = list(range(1, len(y) + 1)), list(range(-1, len(y) - 1))
    heap = [(r, k, p) for k in range(len(y) - 1) if (r := ranks.get(p := y[k] + y[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, piece = heapq.heappop(heap)
        nxt = after[k]
        if y[k] is None or nxt >= len(y) or y[k] + y[nxt] != piece:
            continue  # one of the two has been joined meanwhile
        y[k], y[nxt] = piece, None
        after[k] = after[nxt]
        if after[k] < len(y):
            before[after[k]] = k
        for a, b in ((before[k], k), (k, after[k])):
            if a >= 0 and b < len(y) and (r := ranks.get(p := y[a] + y[b])) is not None:
                heapq.heappush(heap, (r, a, p))
    return [p for p in y if p is not None]


def encode_merges(df: DataFrame, pieces: DataFrame, pieces_bound: int, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pair-merge encode (F1): whitespace words, ``▁`` prefix, pieces joined by rank (score -1 before -2 ...),
    user-defined symbols as their ids, byte fallback for characters outside the table. Rows without words
    are left out (B2). ``pieces``: id, piece, score, type, of at most ``pieces_bound`` rows (checked)."""
    rows = E._held(pieces.where("type = 'NORMAL'").select("id", "piece", "score"), pieces_bound)
    ids = {r["piece"]: r["id"] for r in rows}
    ranks = {r["piece"]: -r["score"] for r in rows if len(r["piece"]) > 1}
    held = df.sparkSession.sparkContext.broadcast((ids, ranks))
    special = {p: [i] for i, p, _ in T.SPECIAL_PIECES if p in T.USER_DEFINED}

    def pieces_of() -> Callable[[str], list[int]]:
        ids, ranks = held.value
        memo = dict(special)

        def find(word: str) -> list[int]:
            if (got := memo.get(word)) is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                    memo.update(special)
                got = memo[word] = []
                for p in split_word(T.WORD_BOUNDARY + word, ranks):
                    if p in ids:
                        got.append(ids[p])
                    else:
                        got += [T.BYTE_BASE + b for b in p.encode("utf-8", "replace")]
            return got

        return find

    return E.map_words(df, (id_col, *keep), T.words(F.col(text_col)), pieces_of)
