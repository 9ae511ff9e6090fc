"""Pair merges in exact batches against the plain trainer, and the encoder against rescans."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import encode as E
from quire.operators import merges as M
from quire.operators import vocab as V
from quire.plans import common as C
from tests.conftest import SF_SMALL


def plain_merges(words: dict, n: int):
    """One merge, one full count."""
    table = [(list(T.WORD_BOUNDARY + w), c) for w, c in words.items()]
    out = []
    while len(out) < n:
        pairs = Counter()
        for y, c in table:
            for p in zip(y, y[1:]):
                pairs[p] += c
        if not pairs:
            break
        (left, right), places = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        out.append((len(out), left, right, places))
        table = [(M.merged(y, left, right), c) for y, c in table]
    return out


def counted(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, cnt long")


@pytest.mark.parametrize("most,n", [(4, 8), (60, 25), (200_000, 150)])
def test_batches_equal_the_plain_trainer(spark, monkeypatch, most, n):
    """Random words over few letters: ties and runs of one letter."""
    monkeypatch.setattr(M, "FIRST_PAIRS", 8)
    rng = random.Random(most)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randint(1, 12))): rng.choice([1, 2, 5, 5, 30]) for _ in range(250)}
    words |= {"a" * n: rng.randint(1, 60) for n in range(1, 40)}
    want = plain_merges(words, n)
    assert M.train_merges(counted(spark, words), n, V.stored, max_fragments=most) == want


def test_merges_of_the_documents_equal_the_plain_trainer(spark):
    docs = C.table(spark, SF_SMALL, "documents")
    words = {r.word: r.cnt for r in V.word_counts(docs).collect() if r.word not in T.USER_DEFINED}
    assert V.bpe_merges(docs, 200) == plain_merges(words, 200)


def test_a_piece_that_exists_ends_the_batch():
    fragments = [(["a", "b", "c"], 9), (["d", "e"], 5), (["d", "e", "a"], 1)]
    assert M.merge_fragments(fragments, 0, 9, set()) == [("a", "b", 9), ("ab", "c", 9), ("d", "e", 6), ("de", "a", 1)]
    assert M.merge_fragments(fragments, 0, 9, {"abc"}) == [("a", "b", 9), ("ab", "c", 9)]
    assert M.merge_fragments(fragments, 6, 9, set()) == [("a", "b", 9), ("ab", "c", 9)]


def test_merges_end_with_the_pairs(spark):
    assert M.train_merges(counted(spark, {"ab": 3, "b": 1}), 50, V.stored) == plain_merges({"ab": 3, "b": 1}, 50)
    assert M.train_merges(counted(spark, {}), 5, V.stored) == []


def rescan(word, ranks):
    y = list(word)
    while True:
        best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(y, y[1:])) if a + b in ranks), default=None)
        if best is None:
            return y
        k = best[1]
        y[k : k + 2] = [y[k] + y[k + 1]]


def test_split_equals_rescans():
    rng = random.Random(2)
    for _ in range(300):
        ranks = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))): float(k) for k in range(rng.randint(0, 25))}
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        assert M.split_word(word, ranks) == rescan(word, ranks)


def test_encode_round_trip_and_training_segmentation(spark):
    docs = C.table(spark, SF_SMALL, "documents")
    pieces = V.bpe_piece_table(spark, docs, 300, coverage=0.995)
    rows = pieces.collect()
    bound = len(rows)
    enc = M.encode_merges(docs, pieces, bound)
    dec = {r.doc_id: r.text for r in E.decode_ids(enc, pieces, bound).collect()}
    want = {r.doc_id: r.t for r in docs.select("doc_id", T.collapse_whitespace(F.col("text")).alias("t")).collect()}
    assert dec == {k: v for k, v in want.items() if v}
    ids = {r.piece: r.id for r in rows}
    ranks = {r.piece: -r.score for r in rows if r.type == "NORMAL" and len(r.piece) > 1}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in enc.limit(30).collect():
        got = []
        for w in texts[r.doc_id].split():
            for p in rescan(T.WORD_BOUNDARY + w, ranks):
                got += [ids[p]] if p in ids else [T.BYTE_BASE + b for b in p.encode()]
        assert list(r.ids) == got
    with pytest.raises(ValueError):
        M.encode_merges(docs, pieces, 200)


def test_loader_takes_the_merge_encoder(spark):
    from quire.plans import loader as L
    from quire.plans import params as P
    from quire.sources import registry as R

    docs = C.table(spark, SF_SMALL, "documents")
    pieces = V.bpe_piece_table(spark, docs, 50)
    out = L.pretrain_batches(
        spark, R.documents_registry(SF_SMALL), lambda df: M.encode_merges(df, pieces, 10_000, keep=("genre",)), batch_size=4, seq_length=32,
        stopping_strategy="all_exhausted_without_replacement", num_workers=2, shuffle_seed=P.SEED,
    )
    assert out.where(F.size("input_ids") != 32).count() == 0 and out.count() > 100
