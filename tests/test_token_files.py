"""Blocks cut from token files equal those of shuffled token arrays, and no token passes an exchange."""

import random
import re

import pytest

from quire.operators import offsets as O
from quire.operators import pack as G
from quire.operators import token_files as K
from quire.plans import catalog as Q
from quire.sources import sinks as S
from tests.conftest import SF_SMALL

SCHEMA = "shard int, pos long, doc_id long, ids array<int>"


def _docs(spark, n=60, twice=False):
    draw = random.Random(7)
    rows = [(p % 2, p, 100 + p, [draw.randrange(5, 90_000 if p % 9 else 60) for _ in range(draw.randrange(1, 30))]) for p in range(n)]
    rows += [(1, n, 7, [draw.randrange(5, 300) for _ in range(2 * K.FRAME + 77)]), (0, n + 1, 8, [9])]
    return spark.createDataFrame(rows * (1 + twice), SCHEMA).repartition(5)


@pytest.mark.parametrize("drop_last", [True, False])
@pytest.mark.parametrize("add_eos", [True, False])
@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
def test_equal_to_shuffled_tokens(spark, monkeypatch, size, add_eos, drop_last):
    monkeypatch.setattr(K, "STRETCH_TOKENS", 128)
    docs, bk = _docs(spark), O.dense_range_bucketing("pos", 0, 61, 4)
    if size == 1:
        docs = docs.where("doc_id > 50")
    folder = K.new_folder(docs)
    stored = K.write_ids(docs, folder)
    want = G.pack_blocks(docs, size, bk, add_eos=add_eos, drop_last=drop_last)
    got = K.pack_stored(stored, folder, size, bk, add_eos=add_eos, drop_last=drop_last)
    assert got.dtypes == want.dtypes and got.count() > 0 or size == 100_000
    assert sorted(got.collect()) == sorted(want.collect())


def test_documents_that_share_a_key_are_laid_as_before(spark):
    docs, bk = _docs(spark, 12, twice=True).where("doc_id > 50"), O.dense_range_bucketing("pos", 0, 11, 2)
    folder = K.new_folder(docs)
    got = K.pack_stored(K.write_ids(docs, folder), folder, 8, bk, drop_last=False)
    assert sorted(got.collect()) == sorted(G.pack_blocks(docs, 8, bk, drop_last=False).collect())


def test_nothing_to_pack(spark):
    docs = _docs(spark).where("pos < 0")
    folder = K.new_folder(docs)
    assert K.pack_stored(K.write_ids(docs, folder), folder, 8, O.dense_range_bucketing("pos", 0, 0, 1)).collect() == []


@pytest.mark.parametrize("q", [Q.g_loader, Q.g_loader_tail])
def test_the_loader_moves_addresses(spark, q):
    """Of a document that the mix repeats, no exchange carries the tokens."""
    plan = q(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and not re.search(r"\b(toks|ids|pcs)#", plan), plan


def test_the_loader_without_a_file_system(spark, monkeypatch):
    """A shared folder that Python cannot open: the tokens are shuffled, the blocks are the same."""
    got = sorted(Q.g_loader_tail(spark, SF_SMALL).collect())
    monkeypatch.setattr(K, "new_folder", lambda docs: None)
    assert sorted(Q.g_loader_tail(spark, SF_SMALL).collect()) == got


def test_ordered_blocks_are_written_without_a_shuffle_of_blocks(spark, monkeypatch, tmp_path):
    """Only addresses are dealt in ranges; files and manifest keep the order of the stream."""
    frame = type(spark.range(1))
    dealt, deal = [], frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: dealt.append(self.columns) or deal(self, *a))
    monkeypatch.setattr(K, "STRETCH_TOKENS", 256)
    monkeypatch.setattr(K, "TOKENS_PER_TASK", 4096)
    rows = S.read_blocks(spark, S.write_blocks(Q.packed(spark, SF_SMALL, ordered=True), str(tmp_path / "blocks"), ordered=True)).collect()
    assert all(r.place == r.block_id for r in rows)
    assert sorted((r.shard, r.block_id, r.input_ids) for r in rows) == sorted(
        (r.shard, r.block_id, r.input_ids) for r in Q.packed(spark, SF_SMALL).collect())
    assert dealt and not any("input_ids" in names for names in dealt)
