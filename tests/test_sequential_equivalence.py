"""Closed forms against plain sequential versions of the same rules.

The sequential versions below are written from the stated semantics (a token
buffer emitting blocks of S+1 with stride S; a draw loop that reads the next
row of the drawn source), then compared with the Spark operators on random
inputs."""

import hashlib
import random

import pytest
from pyspark.sql import Row

from quire.operators import mix as M
from quire.operators import offsets as O
from quire.operators import pack as G


def sequential_pack(docs, S, eos=2, pad=3, drop_last=True, ignore=-100):
    buf, out = [], []
    for ids in docs:
        if not ids:
            continue
        buf.extend(ids + [eos])
        while len(buf) >= S + 1:
            out.append((buf[:S], buf[1 : S + 1], [1] * S))
            del buf[:S]
    if not drop_last and len(buf) > 1:
        padded = buf + [pad] * (S + 1 - len(buf))
        labels = padded[1 : S + 1]
        labels = [x if i < len(buf) - 1 else ignore for i, x in enumerate(labels)]
        out.append((padded[:S], labels, [1] * min(len(buf), S) + [0] * (S - min(len(buf), S))))
    return out


@pytest.mark.parametrize("case", range(6))
def test_pack_equals_sequential_buffer(spark, case):
    rnd = random.Random(case)
    S = rnd.randint(1, 9)
    docs = [[rnd.randint(10, 99) for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 13]))] for _ in range(rnd.randint(1, 12))]
    rows = [Row(shard=0, pos=i, doc_id=i, ids=d) for i, d in enumerate(docs) if d]
    if not rows:
        return
    df = spark.createDataFrame(rows, "shard int, pos long, doc_id long, ids array<int>")
    for drop_last in (True, False):
        got = G.pack_blocks(df, S, O.dense_range_bucketing("pos", 0, 20, 3), drop_last=drop_last)
        got = [(list(r.input_ids), list(r.labels), list(r.attention_mask)) for r in got.orderBy("block_id").collect()]
        assert got == sequential_pack(docs, S, drop_last=drop_last), (S, docs, drop_last)


def _u(seed, k):
    return int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:13], 16) / 2**52


def sequential_interleave(sizes, weights, seed, strategy):
    cum, acc = [], 0.0
    for w in weights:
        acc += w
        cum.append(acc)
    nxt = [0] * len(sizes)
    done = [False] * len(sizes)
    out, k = [], 0
    while True:
        u = _u(seed, k)
        s = next((i for i, c in enumerate(cum) if u < c), len(cum) - 1)
        k += 1
        if strategy == "all_exhausted_without_replacement" and done[s]:
            continue
        out.append((s, nxt[s] % sizes[s]))
        nxt[s] += 1
        if nxt[s] == sizes[s]:
            done[s] = True
            if strategy == "first_exhausted" or all(done):
                return out


@pytest.mark.parametrize("case", range(4))
def test_interleave_equals_draw_loop(spark, case):
    rnd = random.Random(100 + case)
    n_src = rnd.randint(2, 4)
    sizes = [rnd.randint(1, 6) for _ in range(n_src)]
    raw = [rnd.random() + 0.05 for _ in range(n_src)]
    weights = [x / sum(raw) for x in raw]
    weights[-1] = 1.0 - sum(weights[:-1])
    genres = [f"g{i}" for i in range(n_src)]
    rows = [Row(doc_id=100 * i + j, genre=genres[i], text=f"{i}:{j}") for i in range(n_src) for j in range(sizes[i])]
    src = spark.createDataFrame(rows, "doc_id long, genre string, text string")
    seed = rnd.randint(0, 1000)
    for strategy in M.STRATEGIES:
        got = [r.text for r in M.interleave(spark, src, genres, weights, seed=seed, strategy=strategy).orderBy("k").collect()]
        want = [f"{s}:{j}" for s, j in sequential_interleave(sizes, weights, seed, strategy)]
        assert got == want, (sizes, weights, seed, strategy)
