"""The registered trie query against counting of trigrams, and what its batches leave to the shards."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ngram_lm
from quire.llm.catalog import QUERIES
from quire.llm.common import fold
from tests.llm.helpers import crc_mod, frame, sentence
from tests.llm.test_models import counted


def test_query_scores_trigrams(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randint(1, 40)), "en", "s", 1) for i in range(150)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    held = [crc_mod(i, 7) == 2 for i, *_ in rows]
    want = counted(rows, 3, held)
    got = {r.doc_id: r for r in QUERIES["op3_ngram_trie"](spark, str(tmp_path)).collect()}
    assert max(abs(got[i].score - w[4]) for (i, *_), w in zip(rows, want, strict=True)) < 0.02
    assert max(abs(a[4] - b[4]) for a, b in zip(want, counted(rows, 2, held), strict=True)) > 0.1  # two levels would show


@pytest.mark.parametrize("order", [2, 3, 5])
def test_scores_do_not_depend_on_the_batches(spark, order):
    """Whatever contexts are a batch's own, one or many batches give the same scores."""
    rng = random.Random(1)
    rows = [(i, sentence(rng, 25) + f" only{i} here{i} " + sentence(rng, 5), "en", "s", 1) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s", 1) for i in range(0, 120, 3)]
    want = {i: w[4] for (i, *_), w in zip(rows, counted(rows, order, [crc_mod(i, 7) == 2 for i, *_ in rows]), strict=True)}
    scores = []
    for size, parts in ((200, 2), (1 << 20, 2), (700, 5)):
        got = ngram_lm.score_texts(frame(spark, rows).repartition(parts), fold(F.col("doc_id"), 7) == 2, order, tokens_per_batch=size).collect()
        assert len(got) == len(rows) and all(abs(r.score - want[r.doc_id]) < 0.03 for r in got)
        scores.append(sorted((r.doc_id, r.score) for r in got))
    assert scores[0] == scores[1] == scores[2]


def test_own_contexts_ask_no_shard():
    b = object.__new__(ngram_lm.Batch)
    assert b.contexts(np.array([7, 8, -1]), np.array([3, 5, 0]), np.array([False, True, True])).tolist() == [-2, 8, -1]
    b.shards = 4
    keys = np.array([-20, -11, 5, 9, 40])
    assert sorted(k for _, w in b.dealt(keys) for k in keys[w]) == [5, 9, 40]


def test_packed_grams_do_not_grow_with_the_shards():
    """A key's shard is told once: as many keys in more shards take no more bytes, and come back as they were."""
    rng = np.random.default_rng(4)
    words, contexts = 20_000, 200_000
    sizes = []
    for shards in (1, 12, 96):
        width = (words // shards + 2) * shards + 1
        keys = np.unique(rng.integers(0, contexts, 300_000) * width + np.minimum(rng.zipf(1.3, 300_000), words))
        mine = [(s, keys[keys % shards == s]) for s in range(shards)]
        packed = [ngram_lm.pack_grams(k, width, shards) for _, k in mine]
        assert all(np.array_equal(ngram_lm.unpack_grams(p, width, shards, s), k) for p, (s, k) in zip(packed, mine, strict=True))
        assert max(len(k) for _, k in mine) < 2 * len(keys) / shards
        sizes.append(sum(map(len, packed)))
    assert sizes[2] < 1.15 * sizes[1]
    assert sizes[2] < 0.75 * sum(len(ngram_lm.pack(k, True)) for _, k in mine)
    assert np.array_equal(ngram_lm.unpack_grams(ngram_lm.pack_grams(np.zeros(0, np.int64), 13, 12), 13, 12, 3), np.zeros(0))


def test_answers_move_once(spark, tmp_path, monkeypatch):
    """Batches and answers are bucketed alike: the last join of a model of three levels has no shuffle."""
    plans, write = [], ngram_lm.materialise
    monkeypatch.setattr(ngram_lm, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    rows = [(i, f"a b c{i}", "en", "s", 1) for i in range(40)]
    assert ngram_lm.score_texts(frame(spark, rows), fold(F.col("doc_id"), 7) == 2, 3, tokens_per_batch=20).count() == 40
    assert "FlatMapCoGroupsInArrow" in plans[-1] and "Exchange" not in plans[-1]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quire_lm_")]
