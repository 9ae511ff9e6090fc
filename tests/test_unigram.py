"""Suffix intervals against all sub-strings; the array form of the lattices against paths one by one."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import suffixes as S
from quire.operators import unigram as U
from quire.operators import vocab as V
from quire.plans import common as C
from tests.conftest import SF_SMALL


def random_words(seed, n=60):
    rng = random.Random(seed)
    return {"".join(rng.choice("abc日") for _ in range(rng.randint(1, 9))): rng.randint(1, 5) for _ in range(n)}


def substrings(words, most):
    out = Counter()
    for w, c in words.items():
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + most) + 1):
                out[w[i:j]] += c
    return out


@pytest.mark.parametrize("ranges", [1, 5])
def test_intervals_hold_every_substring_once(spark, ranges):
    words = random_words(ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        wc = spark.createDataFrame(list(words.items()), "word string, cnt long")
        found = S.intervals(wc, 6).cache()
        rows = [(r.piece, r.freq) for r in S.spelt(found).collect()]
        repeats = {r.piece: r.freq for r in S.repeats(found).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    every = substrings(words, 6)
    assert len(rows) == len(every) and dict(rows) == dict(every)
    longer = Counter()
    for p, n in every.items():
        longer[p[:-1]] = max(longer[p[:-1]], n)
    # six characters are the end of the world here: nothing is known to follow them
    want = {p: n for p, n in every.items() if len(p) > 1 and n > 1 and longer[p] < n}
    assert repeats == want


def paths(word, scores, unk):
    """(pieces, score) of every path; a piece outside the table is one character of score ``unk``."""
    if not word:
        yield [], 0.0
        return
    for n in range(1, len(word) + 1):
        p = word[:n]
        if p in scores or n == 1:
            for rest, s in paths(word[n:], scores, unk):
                yield [p, *rest], s + scores.get(p, unk)


def test_lattices_equal_all_paths():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(6)) for _ in range(20)})
    scores = {p: math.log(rng.random()) for p in {w[i:j] for w in words for i in range(6) for j in range(i + 1, 7)} if rng.random() < 0.4}
    table = np.array(sorted(scores), object)
    keys = U.key_of(list(table)).view(np.uint64)
    order = np.argsort(keys)
    lat = U.Lattices(words, keys[order], np.array([scores[p] for p in table[order]]), 4, -9.0)
    z, p = lat.expected()
    short = {k: v for k, v in scores.items() if len(k) <= 4}
    for k, w in enumerate(words):
        every = list(paths(w, short, -9.0))
        total = sum(math.exp(s) for _, s in every)
        assert z[k] == pytest.approx(math.log(total)) and lat.best()[k] == pytest.approx(max(s for _, s in every))
        want = Counter()
        for pieces, s in every:
            for x in pieces:
                want[x] += math.exp(s) / total
        got = Counter()
        for i in range(6):
            for l in range(1, min(4, 6 - i) + 1):
                if lat.known[k, i, l - 1]:
                    got[w[i : i + l]] += p[k, i, l - 1]
        assert {x: v for x, v in want.items() if x in short} == pytest.approx(dict(got))


def test_a_pieces_own_edge_is_left_out():
    scores = {"ab": -1.0, "a": -2.0, "b": -3.5}
    keys = U.key_of(list(scores)).view(np.uint64)
    order = np.argsort(keys)
    values = np.array(list(scores.values()))[order]
    assert U.Lattices(["ab"], keys[order], values, 16, -9.0, whole=False).best()[0] == pytest.approx(-5.5)


def test_training_is_the_same_over_any_partitions(spark):
    docs = C.table(spark, SF_SMALL, "documents").limit(40).select("text").collect()  # a small fixture
    texts = spark.createDataFrame(docs)
    got = []
    for n in ("2", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        history: list = []
        learned = U.train_unigram(spark, texts, 400, seed_size=900, history=history)
        got.append({p: round(s, 6) for p, s in learned})
        sizes = sorted({k for k, _ in history}, reverse=True)
        assert sizes[-1] == 400 and all(b >= int(a * 0.75) for a, b in zip(sizes, sizes[1:]))
        for (a, x), (b, y) in zip(history, history[1:]):
            assert a != b or y >= x - 1e-6
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1]
    chars = {r.ch for r in V.alphabet_from_counts(V.weighted_char_counts(
        V.word_counts(texts).select(F.concat(F.lit(T.WORD_BOUNDARY), "word").alias("w"), "cnt"))).collect()}
    assert chars <= set(got[0])


def test_places_of_keys():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 5000):
        keys = np.unique(rng.integers(1, 2**64 - 1, n, np.uint64) >> np.uint64(3))  # crowded in the lower eighth
        asked = np.concatenate([keys, keys + np.uint64(1), rng.integers(1, 2**64 - 1, 100, np.uint64)])
        at, known = U.Places(keys).find(asked)
        assert list(known) == list(np.isin(asked, keys)) and (keys[at[known]] == asked[known]).all()


def test_words_are_not_shuffled_to_the_scores(spark):
    """An E-step moves sums per piece only; the round's scores are held by every task."""
    rows = [(p, math.log(0.1), int(k)) for p, k in zip("abc", U.key_of(list("abc")))] + [("ab", math.log(0.3), int(U.key_of(["ab"])[0]))]
    scores = spark.createDataFrame(rows, "piece string, score double, key long")
    words = spark.createDataFrame([("ab", 3), ("c", 2), ("abc", 1)], "w string, cnt long").repartition(3).localCheckpoint()
    with U.Model(scores) as model:
        counts = U._expected_counts(words, model, 16)
        plan = counts._jdf.queryExecution().executedPlan().toString()
        got = {r.key: r.e for r in counts.collect()}
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "CoGroup" not in plan
    both = 0.3 / (0.3 + 0.01)  # the share of the piece ab among the paths of ab
    want = {"ab": 4 * both, "a": 4 * (1 - both), "b": 4 * (1 - both), "c": 3.0}
    assert {p: got[k] for p, _, k in rows} == pytest.approx(want)
    assert got[None] == pytest.approx(4 * math.log(0.31) + 3 * math.log(0.1))
