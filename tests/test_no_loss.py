"""Rows, bytes and probability mass that must not get lost."""

import math

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import candidates as I
from quire.operators import clean as B
from quire.operators import encode as E
from quire.operators import evaluate as H
from quire.operators import offsets as O

PIECES = "id int, piece string, score double, type string"


def _pieces(spark):
    rows = [(i, p, 0.0, t) for i, p, t in T.SPECIAL_PIECES] + [(T.BYTE_BASE + b, f"<0x{b:02X}>", 0.0, "BYTE") for b in range(256)]
    return spark.createDataFrame([*rows, (263, "▁a", 0.0, "NORMAL")], PIECES)


def test_decode_keeps_every_row(spark):
    cut = [T.BYTE_BASE + 0xE7, T.BYTE_BASE + 0x8C]  # two of the three bytes of a character
    rows = [(1, [1, 2, 3]), (2, [263, *cut, 263]), (3, []), (4, None), (5, [263, 99999, None, 263]), (6, [T.BYTE_BASE + b for b in "é".encode()])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in E.decode_ids(df, _pieces(spark), 300).collect()}
    assert got == {1: "", 2: "a\ufffd a", 3: "", 4: "", 5: "a a", 6: "é"}


def test_encode_drops_only_rows_without_words(spark):
    vocab = spark.createDataFrame([("a", 263)], "word string, id int")
    df = spark.createDataFrame([(1, "a b", "x"), (2, "", "x"), (3, None, "y"), (4, " \n", "y"), (5, "<mask>a", None), (1, "a b", "x")], "doc_id long, text string, k string")
    got = sorted((r.doc_id, r.k, r.ids) for r in E.encode_words(df, vocab, 1, keep=("k",)).collect() if r.k)
    b = [T.BYTE_BASE + x for x in "▁b".encode()]
    assert got == [(1, "x", [263, *b]), (1, "x", [263, *b])]
    assert [r.ids for r in E.encode_words(df, vocab, 1, keep=("k",)).where("doc_id = 5").collect()] == [[4, 263]]


def test_best_so_far_keeps_values_that_say_nothing(spark):
    rows = [("t", 0, -100.0), ("t", 1, 3.0), ("t", 2, None), ("t", 3, 2.0), ("t", 4, float("nan")), ("t", 5, -100.0), ("t", 6, 2.0), ("t", 7, 1.0)]
    df = spark.createDataFrame(rows, "tag string, step long, value double")
    got = H.best_so_far(df, O.dense_range_bucketing("step", 0, 7, 3)).orderBy("step").collect()
    assert [r.is_best for r in got] == [False, True, False, True, False, False, False, True]


def test_sentence_lines_keep_long_lines(spark):
    df = spark.createDataFrame([(1, "x" * 9000 + "\nshort"), (2, None)], "doc_id long, text string")
    lines = B.sentence_lines(df)
    assert sorted(len(r.line) for r in lines.collect()) == [5, 9000]
    kept, skipped = B.trainer_lines(lines)
    assert [r.line for r in kept.collect()] == ["short"] and tuple(skipped.first()) == (1, 9000)


def test_rest_row_stands_for_the_other_pieces(spark):
    """Filters over explicit rows and a rest row equal the filters over every piece."""
    vocab = 40
    own = [(c, t, math.log((7 * t * c) % 11 + 2)) for c in (1, 2, 3) for t in range(c, 40, 5 + c)]
    contexts = spark.createDataFrame([(1, 0.3), (2, 1.1), (3, -2.0), (4, 0.0)], "ctx_id long, r double")
    explicit = spark.createDataFrame(own, "ctx_id long, token_id int, logit double")
    folded = I.with_rest(contexts, explicit, F.col("r"), vocab)
    have = {(c, t): x for c, t, x in own}
    rest = {1: 0.3, 2: 1.1, 3: -2.0, 4: 0.0}
    full = spark.createDataFrame([(c, t, have.get((c, t), rest[c])) for c in rest for t in range(vocab)], "ctx_id long, token_id int, logit double")
    assert {tuple(r) for r in I.greedy(folded).collect()} == {tuple(r) for r in I.greedy(full).collect()}
    for k in (1, 5, 12, 39):
        a, b = I.softmax(I.top_k(folded, k)), I.softmax(I.top_k(full, k))
        mass = lambda df, n: {r.ctx_id: round(r.m, 9) for r in df.groupBy("ctx_id").agg(F.sum(F.col("prob") * n).alias("m")).collect()}
        assert mass(a, F.col("n")) == mass(b, F.lit(1)) == dict.fromkeys(rest, 1.0)
        assert {r.ctx_id: r.n for r in a.groupBy("ctx_id").agg(F.sum("n").alias("n")).collect()} == {r.ctx_id: r.n for r in b.groupBy("ctx_id").agg(F.count("*").alias("n")).collect()}
    for seed in range(12):
        assert {tuple(r) for r in I.draw(I.softmax(folded), seed).collect()} == {tuple(r) for r in I.draw(I.softmax(full), seed).collect()}
        cut = I.softmax(I.top_p(folded, 0.6))
        ids = cut.select("ctx_id", F.explode(F.when(F.col("token_id").isNotNull(), F.array("token_id")).otherwise(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: I.absent_id(F.col("known"), i)))).alias("token_id"), "prob")
        assert {tuple(r) for r in I.draw(cut, seed).collect()} == {tuple(r) for r in I.draw(ids, seed).collect()}
