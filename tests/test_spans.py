"""Blocks cut from spans of neighbouring blocks: brute force over streams, and token ids of two bytes."""

import random

import pytest

from quire.operators import pack as G


def _expected(docs, S, drop_last):
    stream = [(x, d) for d, toks in docs for x in toks]
    nb = max(0, (len(stream) - 1) // S)
    out = {b: ([x for x, _ in stream[b * S : b * S + S]], [x for x, _ in stream[b * S + 1 : b * S + S + 1]], stream[b * S][1]) for b in range(nb)}
    rest = stream[nb * S :]
    if not drop_last and len(rest) > 1:
        pad = S - len(rest)
        out[nb] = ([x for x, _ in rest] + [3] * pad, [x for x, _ in rest[1:]] + [-100] * (pad + 1), rest[0][1])
    return out


@pytest.mark.parametrize(("S", "drop_last"), [(4, False), (7, True), (600, False), (2000, False)])
def test_blocks_are_those_of_the_stream(spark, S, drop_last):
    rnd = random.Random(S)
    docs = [(d, [rnd.randrange(7, 9000) for _ in range(rnd.choice([1, 2, 3, 50, 1500]))]) for d in range(60)]
    total, rows = sum(len(t) for _, t in docs), []
    start = 0
    for d, toks in docs:
        rows.append((0, d, toks, len(toks), start, total))
        start += len(toks)
    frame = spark.createDataFrame(rows, "shard int, doc_id long, toks array<smallint>, L int, start long, T long")
    blocks = G.cut_blocks(frame, S, drop_last=drop_last, pad_id=3)
    assert dict(blocks.dtypes)["input_ids"] == "array<int>" and dict(blocks.dtypes)["labels"] == "array<int>"
    got = {r.block_id: (list(r.input_ids), list(r.labels), r.first_doc_id) for r in blocks.collect()}
    assert got == _expected(docs, S, drop_last)
