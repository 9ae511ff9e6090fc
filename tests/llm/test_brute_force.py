"""Models and shards against plain loops over the same definitions."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import quality, sharding, toxicity
from quire.llm.catalog import QUERIES
from quire.llm.linear import Ftrl, Rows
from tests.llm.helpers import awkward_rows, frame


def plain_ftrl(rows, labels, model):
    """Follow the regularised leader, one coordinate after another, in batches of the same order."""
    z, n = [0.0] * (model.size + 1), [0.0] * (model.size + 1)

    def weight(i):
        free = i > model.size - model.free
        l1, l2 = (0.0, 0.0) if free else (model.l1, model.l2)
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((model.beta + math.sqrt(n[i])) / model.alpha + l2)

    rng = np.random.default_rng(model.seed)
    for _ in range(model.epochs):
        order = rng.permutation(len(rows)).tolist()
        for at in range(0, len(order), model.batch):
            part = order[at : at + model.batch]
            used = sorted({i for k in part for i, _ in rows[k]}) + [model.size]
            w = {i: weight(i) for i in used}
            g = dict.fromkeys(used, 0.0)
            for k in part:
                x = sum(w[i] * v for i, v in rows[k]) + w[model.size]
                err = 1 / (1 + math.exp(-x)) - labels[k]
                for i, v in rows[k]:
                    g[i] += err * v
                g[model.size] += err
            for i in used:
                sigma = (math.sqrt(n[i] + g[i] ** 2) - math.sqrt(n[i])) / model.alpha
                z[i] += g[i] - sigma * w[i]
                n[i] += g[i] ** 2
    return [weight(i) for i in range(model.size + 1)]


@pytest.mark.parametrize("free", [1, 3])
def test_ftrl_equals_a_plain_loop(free):
    rng = random.Random(free)
    rows = [[(i, float(np.float32(rng.uniform(0.1, 2)))) for i in sorted(rng.sample(range(30), rng.randint(0, 8)))] for _ in range(90)]
    labels = [int(sum(v for i, v in r if i < 10) > 2) for r in rows]
    model = Ftrl(30, l1=0.3, free=free)
    got = model.fit(Rows.of([(np.array([i for i, _ in r], np.int64), np.array([v for _, v in r])) for r in rows]), np.array(labels, float))
    assert got == pytest.approx(plain_ftrl(rows, labels, model), abs=1e-9)
    assert np.count_nonzero(got) > 5


def test_quality_scores_are_dot_products(spark):
    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1) / 10
    hasher = quality.NgramHasher(quality.BITS)
    rows = awkward_rows()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score, r.predicted) for r in quality.score_quality(frame(spark, rows), weights).collect())
    want = []
    for i, t, *_ in rows:
        index, value = hasher(t)
        p = 1 / (1 + math.exp(-(sum(weights[int(a)] * float(v) for a, v in zip(index, value)) + weights[-1])))
        want.append((i is None, i or 0, p, int(p >= 0.7)))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2]) and g[3] == w[3]


def test_chain_probabilities_are_fed_forward():
    """Each link's score is its dot product plus its weights times the probabilities before it."""
    rng = np.random.default_rng(2)
    size = 1 << 6
    chain = toxicity.Chain(["a", "b", "c"], 6, [rng.normal(size=size + 4) for _ in range(3)])
    texts = ["one two three", "", None, "two two four five"]
    hasher = toxicity.StemHasher(6)
    got = chain.predict(Rows.of([hasher(t) for t in texts]))
    for row, t in zip(got, texts):
        index, value = hasher(t)
        before = []
        for w in chain.weights:
            x = sum(w[int(i)] * float(np.float32(v)) for i, v in zip(index, value)) + sum(w[size + k] * p for k, p in enumerate(before)) + w[-1]
            before.append(1 / (1 + math.exp(-x)))
        assert row.tolist() == pytest.approx(before, rel=1e-5)


def test_toxic_rows_are_found_by_small_tables(spark):
    """Recall of toxic rows by itself, with some 400 labels."""
    for sf, least in (("sf0.01", 0.85),):
        found = {r.doc_id: r.toxic for r in QUERIES["op5_toxicity"](spark, f"/root/testdata/{sf}").collect()}
        labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").where("toxic is not null").collect()
        toxic = [r.doc_id for r in labels if r.toxic]
        clean = [r.doc_id for r in labels if not r.toxic]
        assert sum(found[i] for i in toxic) >= least * len(toxic), sf
        assert sum(found[i] for i in clean) <= 0.02 * len(clean), sf


def cost(key, shard, weight):
    h = 42
    for part in (struct.pack("<i", sharding.SEED), struct.pack("<i", shard), None if key is None else key.encode(), struct.pack("<i", int(key is None))):
        if part is not None:
            h = xxhash.xxh64_intdigest(part, h)
    return -math.log(((h >> 11) + 0.5) / 2**53) / weight


@pytest.mark.parametrize("weights", [[1.0] * 16, [0.5, 1.0, 4.0, 2.5]])
def test_shards_have_the_least_cost(spark, weights):
    keys = [None, "", *map(str, range(-20, 3000, 7))]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: r.shard for r in df.select("key", sharding.rendezvous(F.col("key"), weights)["shard"].alias("shard")).collect()}
    assert got == {k: min(range(len(weights)), key=lambda j: (cost(k, j, weights[j]), j)) for k in keys}


def test_documents_go_to_the_least_cost(spark):
    n = 16
    rows = sharding.shard_documents(frame(spark, awkward_rows()), n).collect()
    for r in rows:
        key = None if r.doc_id is None else str(r.doc_id)
        order = [cost(key, j, 1.0) for j in range(n + 1)]
        assert r.shard == order.index(min(order[:n])) and r.grown_shard == order.index(min(order))
