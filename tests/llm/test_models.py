"""The n-gram trie against counting, the classifiers on held-out rows, nearest neighbours against all products."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, ngram_lm, quality, toxicity
from quire.llm.common import fold
from quire.llm.elias_fano import EliasFano
from quire.llm.linear import Ftrl, Rows, sigmoid
from tests.llm.helpers import SCHEMA, awkward_rows, crc_mod, frame, sentence, space_words

# --- n-gram trie --------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "universe"), [(0, 1), (1, 1), (1, 1000), (5, 7), (800, 800), (900, 10**9), (4000, 12_000), (700, 1 << 50)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n))
    e = EliasFano.build(v, universe)
    assert np.array_equal(e.access(np.arange(n)), v)
    x = np.concatenate([rng.integers(0, universe + 5, 500), v, v + 1, np.maximum(v - 1, 0)])
    assert np.array_equal(e.next_geq(x), np.searchsorted(v, x))


@pytest.mark.parametrize("width", [50, 10**6])
def test_trie_level_finds_exactly_its_grams(width):
    rng = np.random.default_rng(width)
    keys = np.unique(rng.integers(0, 200 * width, 3000))
    prob = rng.random(len(keys)) * 0.99 + 0.005
    level = ngram_lm.Level(keys, prob, width)
    asked = np.unique(np.concatenate([keys, rng.integers(0, 210 * width, 3000)]))
    at = np.searchsorted(keys, asked)
    want = np.where((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == asked), at, -1)
    assert np.array_equal(level.find(asked), want)
    back = ngram_lm.decode(level.code(level.find(keys)), level.low, level.step)
    assert np.abs(np.log10(back) - np.log10(prob)).max() <= level.step
    assert (ngram_lm.decode(level.code(np.array([-1, -1])), level.low, level.step) == 0).all()


def test_arrays_round_trip():
    rng = np.random.default_rng(0)
    for a in (np.zeros(0, np.int64), np.array([0]), rng.integers(0, 200, 50), rng.integers(0, 1 << 40, 500), np.sort(rng.integers(0, 1 << 62, 500))):
        assert np.array_equal(ngram_lm.unpack(ngram_lm.pack(a)), a)
        assert np.array_equal(ngram_lm.unpack(ngram_lm.pack(np.sort(a), True)), np.sort(a))


def counted(rows, order, held):
    texts = [[*space_words(t), "\0"] for _, t, *_ in rows]
    grams = [collections.Counter() for _ in range(order + 1)]
    for s, h in zip(texts, held, strict=True):
        if not h:
            for k in range(1, order + 1):
                full = s if k == 1 else ["\0", *s]
                grams[k].update(tuple(full[j : j + k]) for j in range(len(full) - k + 1))
    n, v, m = sum(grams[1].values()), len(grams[1]), ngram_lm.MASS
    out = []
    for s in texts:
        full, score, base, known = ["\0", *s], 0.0, 0.0, 0
        for j in range(1, len(full)):
            c = grams[1][(full[j],)]
            p = (c + 1) / (n + v + 1)
            base += math.log10(p)
            known += c > 0
            for k in range(2, min(order, j + 1) + 1):
                context = tuple(full[j - k + 1 : j])
                total = grams[k - 1][context]
                p = grams[k][(*context, full[j])] / (total + m) + m / (total + m) * p
            score += math.log10(p)
        out.append((len(s), known, n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 4])
def test_scores_equal_counting(spark, order):
    rows = awkward_rows()
    df = frame(spark, rows, extra=True)
    got = ngram_lm.score_texts(df.repartition(3), fold(F.col("doc_id"), 7) == 2, order, tokens_per_batch=5000).collect()
    held = [crc_mod(i, 7) == 2 for i, *_ in rows]
    want = sorted(((i, h, *c) for (i, *_), h, c in zip(rows, held, counted(rows, order, held), strict=True)), key=lambda x: repr(x[:6]))
    shown = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda x: repr(x[:5]))
    want.sort(key=lambda x: repr(x[:5]))
    assert [x[:5] for x in shown] == [x[:5] for x in want]
    group = lambda rows_: {k: sorted(x[5:] for x in rows_ if x[0] == k) for k in {x[0] for x in rows_}}
    a, b = group(shown), group(want)
    for k in a:
        for (base, score), (base2, score2), n in zip(a[k], b[k], [x[2] for x in shown if x[0] == k], strict=True):
            assert base == pytest.approx(base2, rel=1e-9, abs=1e-9) and abs(score - score2) <= 1e-3 * max(n, 40_000 if abs(score2) > 1e4 else n)


def test_model_beats_single_words_on_held_out(spark, ):
    rng = random.Random(2)
    phrases = [sentence(rng, 6) for _ in range(12)]
    df = frame(spark, [(i, " ".join(rng.choice(phrases) for _ in range(15)), "en", "s", 1) for i in range(300)])
    got = ngram_lm.score_texts(df, fold(F.col("doc_id"), 7) == 2, 3).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * 0.9


# --- classifiers -----------------------------------------------------------------------------


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(5)
    rows, y = [], []
    for _ in range(600):
        label = rng.random() < 0.3
        f = np.unique(np.concatenate([rng.integers(10, 500, 12), [3] if label else [4]]))
        rows.append((f, np.ones(len(f))))
        y.append(float(label))
    r, y = Rows.of(rows), np.array(y)
    w = Ftrl(500, l1=2.0).fit(r.take(np.arange(400)), y[:400])
    p = sigmoid(r.take(np.arange(400, 600)).dot(w) + w[-1])
    assert ((p > 0.5) == y[400:]).mean() > 0.97 and (w != 0).sum() < 250
    assert sigmoid(Ftrl(5).fit(Rows.of([]), np.zeros(0))[-1]) == 0.5
    assert sigmoid(Ftrl(5).fit(Rows.of([(np.array([1]), np.ones(1))] * 9), np.ones(9))[-1]) > 0.9


def labelled(seed=7, n=500):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 4 == 0
        text = sentence(rng, rng.randint(20, 80))
        if bad:
            text = " ".join(w + rng.choice(["%%", "$$"]) for w in text.split())
        if toxic:
            text += " you " + rng.choice(["vileling", "vileness", "vilest", "grubbish"]) + " " + sentence(rng, 5)
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 7:
            labels.append((i, int(not bad), int(toxic)))
    return docs, labels + [(None, 1, 0), (3, 0, 1), (3, 1, 1), (8, None, None), (9999, 1, 1)]


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled()
    df = frame(spark, docs + awkward_rows()[60:], extra=True)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score_quality(df, quality.fit_quality(df, lab)).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 500 and crc_mod(r.doc_id, 4) == 2 and r.doc_id >= 110]
    assert len(held) > 60 and np.mean([r.predicted == int(r.doc_id % 5 != 0) for r in held]) > 0.95
    # labels of the held-out fold are not read
    flipped = lab.withColumn("quality", F.when(fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit_quality(df, lab), quality.fit_quality(df, flipped))


def test_toxicity_chain(spark):
    docs, labels = labelled()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = frame(spark, docs, extra=True)
    chain = toxicity.fit_toxicity(df.where("doc_id % 3 <> 1"), lab)
    assert chain.names == ["toxic", "toxic_prose", "toxic_junk"]
    got = toxicity.score_toxicity(df, chain)
    assert [c for c in got.columns if c not in ("toxicity", "toxic_p", "rejected")] == [c for c in df.columns if c != "rejected"]
    rows = got.where("doc_id % 3 = 1").collect()
    assert np.mean([r.rejected == (r.doc_id % 4 == 0) for r in rows]) > 0.97
    assert all([s.category for s in r.toxicity] == chain.names and r.toxic_p == max(s.p for s in r.toxicity) for r in rows)
    awkward = toxicity.score_toxicity(frame(spark, awkward_rows()), chain)
    assert awkward.count() == len(awkward_rows()) and awkward.where("rejected").count() == 0


def test_chain_uses_out_of_fold_probabilities():
    """The second category is the first one's label with noise: its link leans on the earlier probability."""
    rng = np.random.default_rng(0)
    rows = [(np.array([int(k), 50 + int(j)]), np.full(2, 3.0)) for k, j in zip(rng.integers(0, 2, 900), rng.integers(0, 40, 900), strict=True)]
    first = np.array([float(i[0]) for i, _ in rows])
    labels = np.stack([first, np.where(rng.random(900) < 0.9, first, np.nan)], axis=1)
    chain = toxicity.fit_chain(Rows.of(rows), labels, np.arange(900) % 3, ["a", "b"], 7)
    assert chain.weights[1][128] > 0.5
    p = chain.predict(Rows.of(rows))
    assert ((p > 0.5) == (first[:, None] > 0.5)).all()


# --- nearest neighbours ------------------------------------------------------------------------


def test_nearest_equals_all_products(spark):
    rng = np.random.default_rng(8)
    vec = rng.standard_normal((700, 12)).astype(np.float32)
    vec[50:80] = vec[20]  # ties
    vec[90:95] *= 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(vec)]
    rows[40] = (40, None)
    rows[41] = (41, [0.0] * 12)
    rows[60] = (60, [float("nan")] * 12)
    rows[61] = (61, [1.0, None] + [0.0] * 10)
    rows[62] = (62, [float("inf")] * 12)
    rows[63] = (63, [1.0, 2.0])
    rows[80] = (80, [])
    rows += [(1000, [1.0, 2.0]), (1020, [3.0, 1.0]), (None, vec[3].tolist()), rows[7], rows[20], (8, vec[9].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("dim", "n", "qb", "cb", "rank", "score", "v")})
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, 16, 64).collect()]
    good = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        best: dict = {}
        for x in (v for i, v in good if i == q):
            for i, v in good:
                if i != q and len(v) == len(x):
                    s = 0.0
                    for a, b in zip(x, v, strict=True):
                        s += float(np.float32(a)) * float(np.float32(b))
                    best[i] = max(best.get(i, -math.inf), s)
        want += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20], 1)]
    assert sorted(got) == want
    assert any(s for *_, s in got)


def test_nearest_counts_ids_not_rows(spark):
    """An id of more vectors than k takes one place, also where all its rows are the best."""
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 0.0, 0.0])] + [(7, [9.0 + j, 0.1, 0.0]) for j in range(25)] + [(100 + j, rng.random(3).tolist()) for j in range(100)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") == 0, 20).collect()]
    best = {i: max(v[0] for j, v in rows if j == i) for i, _ in rows if i}
    assert sorted(got) == [(r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20], 1)]


def test_nearest_beyond_the_range_of_doubles(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 0.0]), (2, [-1e200, 0.0]), (3, [1.0, 5.0]), (4, [1e-310, 0.0]), (5, [1e-320, 1e-320]), (6, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in sorted(ann.nearest(df, F.col("vec_id") == 0, 20).collect(), key=lambda r: r.rank)]
    want = sorted(((i, v[0] * 1e200 + v[1] * 1.0) for i, v in rows if i), key=lambda x: (-x[1], x[0]))
    assert got == want and got[0][1] == math.inf and got[-1][1] == -math.inf


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ngram_lm.score_texts(docs, fold(F.col("doc_id"), 7) == 2).count() == 0
    some = frame(spark, awkward_rows()[:4])
    assert {r.score for r in quality.score_quality(some, quality.fit_quality(docs, lab)).collect()} == {0.5}
    chain = toxicity.fit_toxicity(docs, lab)
    assert toxicity.score_toxicity(docs, chain).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
    # no training rows: every text is scored without counts
    all_held = ngram_lm.score_texts(some, F.lit(True), 2).collect()
    assert len(all_held) == 4 and all(r.train_tokens == 0 and r.n_known == 0 for r in all_held)
