"""Streams in arrivals against sequential loops; the buffer shuffle against a buffer; the loader's plan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import offsets as O
from quire.operators import order as D
from quire.plans import catalog as Q
from quire.session import shared_path
from quire.streaming import pack_stream as J
from tests.conftest import SF_SMALL

SCHEMA = "shard int, pos long, doc_id long, ids array<int>"


def arrive(spark, base, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(3).write.mode("append").parquet(f"{base}/source")
    J.pack_arrival(spark, spark.readStream.schema(df.schema).parquet(f"{base}/source"), kw.pop("S", 4), base, **kw)


def sequential(rows, S, max_samples=None, eos=2):
    """(shard, block, inputs, labels) of one buffer per shard, and what it holds in the end."""
    out, rest = [], {}
    for shard in sorted({r[0] for r in rows}):
        buf, k, n = [], 0, 0
        for _, _, _, ids in sorted((r for r in rows if r[0] == shard), key=lambda r: r[1]):
            if not ids or max_samples is not None and n == max_samples:
                continue
            n += 1
            buf += [*ids, eos]
            while len(buf) > S:
                out.append((shard, k, buf[:S], buf[1 : S + 1]))
                buf, k = buf[S:], k + 1
        rest[shard] = (k, buf)
    return out, rest


def shard_rows(seed, n, shards=(0, 0, 0, 0, 1)):
    rng = random.Random(seed)
    return [(rng.choice(shards), p, p, rng.choice([None, [], [7] * 11, [rng.randint(5, 99) for _ in range(rng.randint(1, 6))]])) for p in range(n)]


@pytest.mark.parametrize("cuts", [(0, 120), (0, 1, 40, 40, 80, 120)])
@pytest.mark.parametrize("limit", [None, 9])
def test_arrivals_equal_one_buffer_per_shard(spark, cuts, limit):
    """One arrival of two shards, one of them dominant, and many arrivals, one of them empty."""
    base, rows = shared_path(spark, "t-arrivals"), shard_rows(3, 120)
    for a, b in zip(cuts, cuts[1:]):
        arrive(spark, base, rows[a:b], max_samples=limit)
    want, rest = sequential(rows, 4, limit)
    got = [(r.shard, r.block_id, list(r.input_ids), list(r.labels)) for r in J.packed_blocks(spark, base, 4).collect()]
    assert sorted(got) == want
    tails = {r.shard: r for r in J.packed_blocks(spark, base, 4, drop_last=False).collect() if sum(r.attention_mask) < 4 or list(r.labels)[-1] == -100}
    for shard, (k, buf) in rest.items():
        if len(buf) > 1:
            t = tails[shard]
            assert (t.block_id, list(t.input_ids)[: len(buf)], sum(t.attention_mask)) == (k, buf, len(buf))
            assert list(t.labels) == buf[1:] + [-100] * (5 - len(buf))
        else:
            assert shard not in tails


def test_a_run_cut_short_is_done_again(spark):
    """The blocks of an arrival without a ledger entry are replaced, not doubled."""
    base, rows = shared_path(spark, "t-replay"), shard_rows(5, 60)
    arrive(spark, base, rows[:30])
    keep = J.arrivals
    # the second arrival is staged and packed, but its ledger entry is never written
    df = spark.createDataFrame(rows[30:50], SCHEMA)
    df.write.mode("append").parquet(f"{base}/source")
    src = spark.readStream.schema(df.schema).parquet(f"{base}/source")
    J.run_available(spark, src.withColumn("arrival", F.lit(1)), f"{base}/staged", f"{base}/checkpoint", "arrival")
    df.select("shard", F.lit(0).cast("long").alias("block_id")).write.parquet(f"{base}/out/arrival=1")
    assert keep(spark, base) == 1
    arrive(spark, base, rows[50:])
    assert keep(spark, base) == 2
    got = [(r.shard, r.block_id, list(r.input_ids), list(r.labels)) for r in J.packed_blocks(spark, base, 4).collect()]
    assert sorted(got) == sequential(rows, 4)[0]


def test_best_over_arrivals_with_a_dominant_tag(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), s, rng.choice([None, float("nan"), -100.0, round(rng.uniform(0, 50), 3)])) for s in range(200)]
    base = shared_path(spark, "t-best")
    for a in range(0, 200, 50):
        df = spark.createDataFrame(rows[a : a + 50], "tag string, step long, value double")
        df.write.mode("append").parquet(f"{base}/source")
        J.best_arrival(spark, spark.readStream.schema(df.schema).parquet(f"{base}/source"), base)
    got = {(r.tag, r.step): r.is_best for r in J.best_rows(spark, base).collect()}
    best, want = {}, {}
    for tag, step, v in rows:
        said = v is not None and v == v and v != -100.0
        want[tag, step] = said and v < best.get(tag, float("inf"))
        if said:
            best[tag] = min(v, best.get(tag, v))
    assert got == want


def buffer_loop(n, B, slot, key):
    """The buffer itself: fill it, then every further row replaces the one in a random slot."""
    buf, out = list(range(min(B, n))), []
    for t, p in enumerate(range(B, n)):
        out.append(buf[slot(t)])
        buf[slot(t)] = p
    return out + sorted(buf, key=key)


@pytest.mark.parametrize("n,B", [(300, 10), (57, 1), (40, 40), (12, 50), (0, 5)])
def test_buffer_shuffle_is_the_buffer(spark, monkeypatch, n, B):
    import hashlib

    monkeypatch.setattr(O, "MIN_BUCKETS", 7)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    df = spark.range(n).select((F.col("id") * 3).alias("doc_id"), F.col("id").alias("pos"))
    got = [r.pos for r in sorted(D.buffer_shuffle(df, 42, B, n).collect(), key=lambda r: r.spos)]
    assert [r.spos for r in sorted(D.buffer_shuffle(df, 42, B, n).collect(), key=lambda r: r.spos)] == list(range(n))
    want = buffer_loop(n, B, lambda t: int(md5(f"42:slot:{t}")[:13], 16) % B, lambda p: (md5(f"42:{3 * p}:{p}"), p))
    assert got == want


def test_a_limit_ranks_no_token_arrays(spark, monkeypatch):
    """Positions are ranked on narrow rows, and not at all in shards that have their documents."""
    ranked, positions = [], O.global_positions

    def spy(df, *a, **kw):
        ranked.append((set(df.columns), df.select("shard").distinct().count()))
        return positions(df, *a, **kw)

    monkeypatch.setattr(O, "global_positions", spy)
    base = shared_path(spark, "t-narrow")
    rows = [(0, p, p, [p + 5, p + 6]) for p in range(20)] + [(1, p, p, [p + 5]) for p in (20, 45)]
    arrive(spark, base, rows[:21], max_samples=4)
    arrive(spark, base, [(0, p, p, [9]) for p in range(30, 40)] + rows[21:], max_samples=4)
    assert not any("ids" in names for names, _ in ranked) and [n for _, n in ranked] == [2, 1]
    ids = [t for r in sorted(J.packed_blocks(spark, base, 4, drop_last=False).collect()) for t, m in zip(r.input_ids, r.attention_mask) if m]
    assert ids == [5, 6, 2, 6, 7, 2, 7, 8, 2, 8, 9, 2, 25, 2, 50, 2]


@pytest.mark.parametrize("q", [Q.g_loader, Q.g_loader_tail, Q.g_loader_subword])
def test_loader_blocks_are_dealt_by_block(spark, q):
    """The blocks are put together after an exchange on (shard, block), not with one task per shard."""
    df = q(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(shard#\d+, block_id#\d+L", plan), plan
    for m in re.finditer(r"hashpartitioning\(shard#\d+, \d+\)", plan):  # only the small table of bucket bases
        assert "HashAggregate" in plan[m.end() :].split("\n")[1]
