"""Operator 13, spelling variants by blocked Gram matrices of letter counts.

Two words one edit apart have letter counts whose squared distance is 1 (an inserted or
deleted letter) or 2 (a replaced one). Words are put in blocks of one length and one vector of
letter-group sums (letters fall into ``GROUPS`` groups). One edit changes at most one sum by
one up and one sum by one down, so a block meets only the blocks of its own length or one more
whose vector says so: an equi-join of blocks of at most ``BLOCK`` words, no cross join. A
NumPy product of two blocks' letter counts gives all squared distances; pairs at 1 (adjacent
lengths) or 2 (one length) are then verified letter by letter.

Words are counted per task before they are shuffled. A word's form is its near word of largest
count (ties: smallest) where that is at least twice the word's own count; counts at least
double along forms, so pointer jumping ends after a few rounds.

Null and empty texts have no words; a null id is the empty text in the seeded deletion. Very
long runs are words like others. Repeated rows count each time. An empty table gives no rows.
Columns beside the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import LOWER_ASCII, materialise, text_bytes

MIN_LETTERS = 5
MIN_COUNT = 3
DAMAGE = 97
GROUPS = 8
BLOCK = 1024
WORDS_HELD = 300_000  # distinct words a counting task holds before it passes them on
PENDING = 4096  # words that wait for a product with one block
RUN = re.compile("[a-zÀ-ÿ]+")


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, damage: int = DAMAGE) -> DataFrame:
    """word, n over all texts: runs of letters, A-Z lower-cased, one letter taken out where ``damage`` divides the
    CRC-32 of ``id:run`` (0: none)."""
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary").alias("i"), text_bytes(F.col(text_col)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for i, t in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist()):
                begin = zlib.crc32(i + b":")
                for word, n in Counter(RUN.findall(t.translate(LOWER_ASCII).decode())).items():
                    if damage:
                        h = zlib.crc32(word.encode(), begin)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= min_letters:
                        held[word] += n
                if len(held) >= WORDS_HELD:
                    yield out()
        yield out()

    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(codes: np.ndarray) -> np.ndarray:
    """Letter counts of words of one length; codes are rows of Latin-1 bytes."""
    flat = (np.arange(len(codes))[:, None] * 256 + codes).ravel()
    return np.bincount(flat, minlength=256 * len(codes)).reshape(-1, 256)


def _codes(words: list[str]) -> np.ndarray:
    """Latin-1 bytes of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def near_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of rows of ``a`` and ``b`` one edit apart; b's words are as long or one longer."""
    ca, cb = _counts(a), _counts(b)
    used = np.flatnonzero(ca.any(0) | cb.any(0))
    ca, cb = ca[:, used].astype(np.float32), cb[:, used].astype(np.float32)
    far = (ca * ca).sum(1)[:, None] + (cb * cb).sum(1)[None, :] - 2 * (ca @ cb.T)
    longer = b.shape[1] - a.shape[1]
    i, j = np.nonzero(far == (1 if longer else 2))
    keep = []
    for k in range(0, len(i), 1 << 18):
        x, y = a[i[k : k + (1 << 18)]], b[j[k : k + (1 << 18)]]
        if longer:
            differ = x != y[:, :-1]
            first = np.where(differ.any(1), differ.argmax(1), x.shape[1])
            rest = (x != y[:, 1:]) & (np.arange(x.shape[1]) >= first[:, None])
            keep.append(~rest.any(1))
        else:
            keep.append((x != y).sum(1) == 1)
    kept = np.concatenate(keep) if keep else np.empty(0, bool)
    return i[kept], j[kept]


def _blocks(words: DataFrame, groups: int, size: int) -> DataFrame:
    """block, key, words, counts: blocks of one length and one vector of group sums; texts are joined by blanks."""
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    length = F.char_length("word")
    sums = [length - F.char_length(F.translate("word", "".join(c for c in letters if ord(c) % groups == g), "")) for g in range(groups)]
    keyed = words.select("word", "n", F.array(*sums).alias("key"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("word"))
    parts = keyed.withColumn("part", F.floor((rank - 1) / size).cast("long"))
    listed = F.array_sort(F.collect_list(F.struct("word", "n")))
    both = parts.groupBy("key", "part").agg(listed.alias("w"))
    return both.select(
        "key", "part", F.array_join(F.col("w")["word"], " ").alias("words"), F.array_join(F.transform(F.col("w")["n"], lambda n: n.cast("string")), " ").alias("counts")
    )


def _meets(groups: int):
    """The keys that a block of key ``key`` meets: its own, one sum up, one up and an earlier one down."""

    def moved(up: int | None, down: int | None):
        change = [(1 if g == up else 0) - (1 if g == down else 0) for g in range(groups)]
        return F.array(*[F.col("key")[g] + c for g, c in enumerate(change)])

    up = [moved(g, None) for g in range(groups)]
    both = [moved(g, d) for g in range(groups) for d in range(g)]
    return F.filter(F.array(moved(None, None), *up, *both), lambda k: F.array_min(k) >= 0)


def near_words(words: DataFrame, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """word, near, near_n for every ordered pair of words one edit apart. ``words``: word, n, words unique."""
    blocks = materialise(_blocks(words, groups, block), "blocks")
    left = blocks.select(F.col("key").alias("k1"), F.col("part").alias("p1"), F.col("words").alias("w1"), F.col("counts").alias("n1"), F.explode(_meets(groups)).alias("key"))
    # within a key, a pair of parts meets once
    pairs = left.join(blocks, "key").where("k1 <> key or p1 <= part").select("w1", "n1", (F.expr("k1 = key and p1 = part")).alias("same"), F.col("words").alias("w2"), F.col("counts").alias("n2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[str, str]]] = {}  # what waits for a block: words and counts, by their length

        def numbers(parts: list[str]) -> np.ndarray:
            return np.array(" ".join(parts).split(" "), np.int64)

        def product(of: tuple[str, str, int], waiting: list[tuple[str, str]], same: bool) -> pa.RecordBatch:
            b, a = of[0].split(" "), " ".join(w for w, _ in waiting).split(" ")
            i, j = near_pairs(_codes(a), _codes(b))
            if same:
                i, j = i[i < j], j[i < j]
            na, nb = numbers([n for _, n in waiting]), numbers([of[1]])
            a, b = pa.array(a, pa.string()).take(pa.array(i)), pa.array(b, pa.string()).take(pa.array(j))
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([a, b]), pa.concat_arrays([b, a]), pa.array(np.concatenate([nb[j], na[i]]))], names=["word", "near", "near_n"]
            )

        waiting_words = 0
        for batch in batches:
            for w1, n1, same, w2, n2 in zip(*(batch.column(c).to_pylist() for c in ("w1", "n1", "same", "w2", "n2"))):
                if same:
                    yield product((w2, n2, 0), [(w1, n1)], True)
                    continue
                key = (w2, n2, w1.find(" ") if " " in w1 else len(w1))
                mine = held.setdefault(key, [])
                mine.append((w1, n1))
                waiting_words += w1.count(" ") + 1
                if sum(w.count(" ") + 1 for w, _ in mine) >= PENDING:
                    waiting_words -= sum(w.count(" ") + 1 for w, _ in mine)
                    yield product(key, held.pop(key), False)
                elif waiting_words >= 16 * PENDING:
                    for k, v in held.items():
                        yield product(k, v, False)
                    held.clear()
                    waiting_words = 0
        for k, v in held.items():
            yield product(k, v, False)

    return pairs.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame, max_rounds: int = 12) -> DataFrame:
    """word, root: the last of the forms that follow from ``word``. ``forms`` has word, form, never null."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):  # every round doubles the steps taken; counts double along forms, so 2^6 steps are more than any count allows
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        jumped = at.join(up, "root", "left")
        if jumped.where("above is not null").isEmpty():
            return at
        at = materialise(jumped.select("word", F.coalesce("above", "root").alias("root")), "roots")
    raise RuntimeError(f"forms did not settle in {max_rounds} rounds")


def spelling_groups(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word. ``words``: word, n, words unique."""
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.minus") >= 2 * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.minus")).alias("form_n"),
    )
    found = materialise(found, "forms")
    root = roots(found.where("form is not null").select("word", "form"))
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """The spelling groups of the words of ``docs`` with at least ``min_letters`` letters and ``min_count`` places."""
    words = count_words(docs, min_letters=min_letters, damage=damage).where(F.col("n") >= min_count)
    return spelling_groups(materialise(words, "words"))
