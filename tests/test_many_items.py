"""Inner-product top-k takes any number of items."""

import numpy as np
import pytest

from quire.operators import candidates as I


def test_no_bound_on_items(spark, monkeypatch):
    emb = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(type(emb), "count", lambda self: 6_000_000)
    got = I.inner_product_top_k(emb, emb, 5, ctx_block=6_000_000, item_block=1_000_000).collect()
    assert len(got) == 100 and all(r.item_id == 20 - r["rank"] for r in got if r.vec_id > 0)


def test_rows_without_a_vector_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 2.0]), (None, [5.0, 5.0]), (4, [3.0, 1.0]), (5, [])]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r["rank"], r.item_id) for r in I.inner_product_top_k(emb, emb, 5).collect()}
    assert got == {(1, 1, 4), (1, 2, 1), (4, 1, 4), (4, 2, 1)}
    odd = [(5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])]
    emb = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    assert {(r.vec_id, r["rank"], r.item_id) for r in I.inner_product_top_k(emb, emb, 5).collect()} == got


def test_blocks_under_the_bars_are_passed_over(spark):
    """Norms of very different size: equal to all scores, from few tiles."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 8))
    x[7] = 0.0  # all its scores tie: the smallest ids win, wherever their blocks are
    y = rng.standard_normal((900, 8)) * (0.99 ** np.arange(900))[rng.permutation(900), None]
    y[100:104] = y[100]  # ties of equal vectors
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    for k in (1, 5, 60):
        got = {(r.vec_id, r["rank"]): (r.item_id, r.score) for r in I.inner_product_top_k(frame(x), frame(y), k, ctx_block=8, item_block=50).collect()}
        xn = x / np.sqrt(np.mean(x * x, axis=1, keepdims=True) + I.RMS_EPS)
        for c, s in enumerate(xn @ y.T):
            s = np.round(s, 12)
            order = np.lexsort((np.arange(900), -s))[:k]
            assert np.allclose([got[c, r + 1][1] for r in range(k)], s[order], rtol=0, atol=1e-9)
            assert [got[c, r + 1][0] for r in range(k)] == order.tolist() or k > 1 and len(set(s[order])) < k
        assert [got[7, r + 1][0] for r in range(k)] == list(range(k))
    blocks = I.norm_blocks(I._usable(frame(y), "vec_id", "embedding"), 900, 50).cache()
    sizes = [len(r.ii) // 8 for r in blocks.collect()]
    assert sum(sizes) == 900 and max(sizes) <= 50
    left = I._context_blocks(I._usable(frame(np.delete(x, 7, axis=0)), "vec_id", "embedding"), 40, 8)
    pairs = I.needed_tiles(I.with_bars(left, I.head_block(blocks, 50), 5), blocks)
    n_all = left.count() * blocks.select("ib").distinct().count()
    assert 0 < pairs.count() < n_all / 2


def test_no_items_or_no_contexts(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    for left, right in ((emb, emb.where("false")), (emb.where("false"), emb)):
        got = I.inner_product_top_k(left, right, 5)
        assert got.columns == ["vec_id", "rank", "item_id", "score"] and got.count() == 0


def test_every_context_has_its_items(spark, tmp_path):
    from quire.plans import catalog

    rows = [(i, [float(i), 1.0]) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.QUERIES["i_scores"](spark, str(tmp_path)).collect()
    assert {r.ctx_id for r in got} == set(range(30)) and len(got) == 150


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_no_block_is_shuffled_per_pair(spark, monkeypatch, threshold):
    """Item blocks go from their files to the tiles, with a small side or two large ones."""
    emb = spark.createDataFrame([(i, [float(i % 13), 1.0, float(i % 7)]) for i in range(400)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, I.inner_product_top_k(emb, emb, 5).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = I.inner_product_top_k(emb, emb, 5, ctx_block=50, item_block=40)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, out.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(ib#" not in plan and "hashpartitioning(cb#" not in plan, plan
    assert ("CartesianProduct" if threshold == "-1" else "BroadcastNestedLoopJoin") in plan
