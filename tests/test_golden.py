"""Worked cases of FIXTURES.md §3–§4, checked against the operators directly."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import candidates as I
from quire.operators import clean as B
from quire.operators import encode as E
from quire.operators import evaluate as H
from quire.operators import mix as M
from quire.operators import offsets as O
from quire.operators import order as D
from quire.operators import pack as G

DOCS = [[5, 6, 7], [], [8, 9], [10, 11, 12, 13]]


def _stream(spark):
    rows = [Row(shard=0, pos=i, doc_id=i, ids=ids) for i, ids in enumerate(DOCS) if ids]
    return spark.createDataFrame(rows, "shard int, pos long, doc_id long, ids array<int>")


def _pack(spark, S, drop_last):
    bk = O.dense_range_bucketing("pos", 0, 10, 1)
    out = G.pack_blocks(_stream(spark), S, bk, drop_last=drop_last)
    return [(r.input_ids, r.labels, r.attention_mask) for r in out.orderBy("block_id").collect()]


@pytest.mark.parametrize(
    "S,drop_last,expected",
    [
        (4, True, [([5, 6, 7, 2], [6, 7, 2, 8], [1] * 4), ([8, 9, 2, 10], [9, 2, 10, 11], [1] * 4)]),
        (4, False, [([5, 6, 7, 2], [6, 7, 2, 8], [1] * 4), ([8, 9, 2, 10], [9, 2, 10, 11], [1] * 4),
                    ([11, 12, 13, 2], [12, 13, 2, -100], [1] * 4)]),
        (5, True, [([5, 6, 7, 2, 8], [6, 7, 2, 8, 9], [1] * 5), ([9, 2, 10, 11, 12], [2, 10, 11, 12, 13], [1] * 5)]),
        (5, False, [([5, 6, 7, 2, 8], [6, 7, 2, 8, 9], [1] * 5), ([9, 2, 10, 11, 12], [2, 10, 11, 12, 13], [1] * 5),
                    ([13, 2, 3, 3, 3], [2, -100, -100, -100, -100], [1, 1, 0, 0, 0])]),
        (11, False, [([5, 6, 7, 2, 8, 9, 2, 10, 11, 12, 13], [6, 7, 2, 8, 9, 2, 10, 11, 12, 13, 2], [1] * 11)]),
    ],
)
def test_packing(spark, S, drop_last, expected):
    assert _pack(spark, S, drop_last) == expected


def _interleave(spark, strategy):
    rows = [Row(doc_id=i, genre="A", text=f"A{i}") for i in range(2)] + [
        Row(doc_id=10 + i, genre="B", text=f"B{i}") for i in range(3)
    ]
    src = spark.createDataFrame(rows, "doc_id long, genre string, text string")
    out = M.interleave(spark, src, ["A", "B"], [0.5, 0.5], seed=42, strategy=strategy)
    return [r.text for r in out.orderBy("k").collect()]


def test_interleave_golden(spark):
    assert _interleave(spark, "first_exhausted") == ["B0", "A0", "A1"]
    assert _interleave(spark, "all_exhausted") == "B0 A0 A1 A0 B1 A1 A0 A1 A0 A1 B2".split()
    assert _interleave(spark, "all_exhausted_without_replacement") == "B0 A0 A1 B1 B2".split()


def test_uniform_draws(spark):
    got = spark.range(11).select(F.round(T.uniform01(42, "id"), 4).alias("u")).orderBy(F.monotonically_increasing_id())
    assert [r.u for r in got.collect()] == [0.6605, 0.3479, 0.4681, 0.2472, 0.6211, 0.234, 0.244, 0.3282, 0.0234, 0.4426, 0.9814]


def test_shards(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    contig = df.select("pos", D.contiguous_shard(F.col("pos"), 10, 3).alias("s")).collect()
    sizes = [sum(1 for r in contig if r.s == k) for k in range(3)]
    assert sizes == [4, 3, 3]
    rr = df.select("pos", D.round_robin_shard(F.col("pos"), 3).alias("s")).collect()
    assert sorted(r.pos for r in rr if r.s == 0) == [0, 3, 6, 9]
    assert sorted(r.pos for r in rr if r.s == 1) == [1, 4, 7]


def test_byte_cap(spark):
    df = spark.range(5000).select(F.col("id").alias("pos"), F.lit("x" * 99 + "\n").alias("line"))
    bk = O.dense_range_bucketing("pos", 0, 5000, 4)
    out = D.corpus_byte_cap(df, 250_000, bk, check_every=1000)
    assert out.count() == 3001


def test_templates(spark):
    df = spark.createDataFrame([Row(a=[10, 11], b=[12], c=list(range(10, 20)))], "a array<int>, b array<int>, c array<int>")
    ids, types = E.template_pair(F.col("a"), F.col("b"))
    r = df.select(E.template_single(F.col("a")).alias("s"), ids.alias("p"), types.alias("t"),
                  E.truncate_single(F.col("c"), 6).alias("tr")).first()
    assert r.s == [1, 10, 11, 2]
    assert r.p == [1, 10, 11, 2, 12, 2] and r.t == [0, 0, 0, 0, 1, 1]
    assert r.tr == [1, 10, 11, 12, 13, 2]


def test_collate_and_shift(spark):
    df = spark.createDataFrame([Row(item_id=0, batch_id=0, ids=[5, 6, 7]), Row(item_id=1, batch_id=0, ids=[8])],
                               "item_id long, batch_id long, ids array<int>")
    out = {r.item_id: r for r in G.collate(df).collect()}
    assert out[0].input_ids == [5, 6, 7] and out[1].input_ids == [8, 3, 3]
    assert out[0].attention_mask == [1, 1, 1] and out[1].attention_mask == [1, 0, 0]
    assert out[0].labels == [5, 6, 7] and out[1].labels == [8, -100, -100]
    sh = G.collate(df).select("item_id", G.shift_at_use(F.col("labels")).alias("s"))
    shifted = {r.item_id: r.s for r in sh.collect()}
    assert shifted == {0: [6, 7], 1: [-100, -100]}
    valid = sh.agg(F.sum(G.valid_tokens(F.col("s")))).first()[0]
    assert valid == 2


def test_log_perplexity_and_updates(spark):
    df = spark.createDataFrame([(6.0, 3), (2.0, 1)], "nll double, n long")
    v = df.agg(H.log_perplexity(F.sum("nll"), F.sum("n"))).first()[0]
    assert v == 2.0
    empty = df.where("n < 0").agg(H.log_perplexity(F.sum("nll"), F.sum("n"))).first()[0]
    assert empty == -100.0
    bl = spark.createDataFrame([(0, 2.0), (1, 4.0), (2, 5.0)], "batch_id long, loss double")
    assert [tuple(r) for r in H.update_loss(bl, 2).collect()] == [(0, 3.0)]


def test_best_so_far(spark):
    vals = [3.0, 2.5, 2.5, 2.7, 2.1]
    df = spark.createDataFrame([("Loss/Validation", i, v) for i, v in enumerate(vals)], "tag string, step long, value double")
    bk = O.dense_range_bucketing("step", 0, 4, 2)
    out = H.best_so_far(df, bk).orderBy("step").collect()
    assert [r.is_best for r in out] == [True, True, False, False, True]


def _cands(spark):
    rows = [(0, 0, 2.0), (0, 1, 1.0), (0, 2, 1.0), (0, 3, -1.0), (0, 4, -2.0)]  # a b c d e
    return spark.createDataFrame(rows, "ctx_id long, token_id int, logit double")


def test_candidate_filters(spark):
    seen = spark.createDataFrame([(0, 0), (0, 3)], "ctx_id long, token_id int")
    pen = I.repetition_penalty(_cands(spark), seen, 2.0)
    assert {r.token_id: r.logit for r in pen.collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: -2.0, 4: -2.0}
    hot = I.temperature(pen, 0.5)
    k2 = {r.token_id: round(r.prob, 6) for r in I.softmax(I.top_k(hot, 2)).collect()}
    assert k2 == {0: 0.333333, 1: 0.333333, 2: 0.333333}
    k4 = {r.token_id: round(r.prob, 6) for r in I.softmax(I.top_k(hot, 4)).collect()}
    assert k4 == {0: 0.332783, 1: 0.332783, 2: 0.332783, 3: 0.000825, 4: 0.000825}
    probs = [0.5, 0.3, 0.15, 0.05]
    tp = spark.createDataFrame([(0, i, math.log(p)) for i, p in enumerate(probs)], "ctx_id long, token_id int, logit double")
    assert sorted(r.token_id for r in I.top_p(tp, 0.75).collect()) == [0, 1]
    assert I.greedy(_cands(spark)).first().token_id == 0
    with pytest.raises(ValueError):
        I.repetition_penalty(_cands(spark), seen, 0.5)


def test_eos_propagation(spark):
    df = spark.createDataFrame([([7, 2, 9, 9],), ([5, 6, 2, 4],)], "ids array<int>")
    out = df.select(I.propagate_eos(F.col("ids")).alias("p"), I.finished_length(F.col("ids")).alias("n")).collect()
    assert out[0].p == [7, 2, 2, 2]
    assert max(r.n for r in out) == 3


def test_hand_made_rows(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "一文目。二文目。"), (6, "猫 the  x"), (7, "a<|im_start|>user"), (8, "🌙😊👍")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = spark.createDataFrame([("the", 263), ("a", 264), ("user", 265), ("x", 266)], "word string, id int")
    enc = {r.doc_id: r.ids for r in E.encode_words(df, vocab, 10).collect()}
    assert set(enc) == {4, 6, 7, 8}  # NULL, empty and blank text give no tokens (B2)
    assert enc[6][:6] == [7 + 0xE2, 7 + 0x96, 7 + 0x81, 7 + 0xE7, 7 + 0x8C, 7 + 0xAB]
    assert enc[7] == [264, 5, 265]
    assert len(enc[8]) == 3 + 12  # "▁" (3 bytes) + three 4-byte emoji
    lines = B.sentence_lines(df.where("doc_id = 4")).collect()
    assert [r.line for r in lines] == ["一文目。", "二文目。"]
    pieces = spark.createDataFrame(
        [(263, "▁the", 0.0, "NORMAL"), (264, "▁a", 0.0, "NORMAL"), (265, "▁user", 0.0, "NORMAL"), (266, "▁x", 0.0, "NORMAL"),
         (5, "<|im_start|>", 0.0, "USER_DEFINED")]
        + [(7 + b, f"<0x{b:02X}>", 0.0, "BYTE") for b in range(256)],
        "id int, piece string, score double, type string",
    )
    dec = {r.doc_id: r.text for r in E.decode_ids(spark.createDataFrame([(6, enc[6])], "doc_id long, ids array<int>"), pieces, 300).collect()}
    assert dec[6] == "猫 the x"


def test_nfkc(spark):
    df = spark.createDataFrame([("ｱｲｳ ＡＢＣ　①",)], "text string")
    assert df.select(B.nfkc_udf(F.col("text")).alias("n")).first().n == "アイウ ABC　1".replace("　", " ")


def test_decode_step(spark):
    seen = spark.createDataFrame([(0, 0), (0, 3)], "ctx_id long, token_id int")
    assert I.decode_step(_cands(spark), seen, temperature=0.0, penalty=2.0).first().token_id == 0  # greedy, tie -> lowest id
    drawn = I.decode_step(_cands(spark), seen, temperature=0.5, k=2, p=0.95, penalty=2.0, seed=42).first().token_id
    assert drawn in (0, 1, 2)  # only the top-k survivors (a, b, c) can be drawn
