"""The at-scale code path: with a tiny bucket target every two-phase rank,
running sum and running minimum uses many buckets and a broadcast base
table. Results must still equal the SQL twins."""

import pytest

import __spark_entry__ as entry
from quire.operators import offsets as O
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

ORDERED = [
    "g_pack", "g_pack_tail", "flagship", "g_loader", "g_batches", "i_eos", "c_first", "c_all", "c_without_replacement",
    "c_single", "d_shuffle", "d_block_shuffle", "d_shard_contig", "d_limit", "d_limit_global", "d_corpus_rows",
    "d_corpus_bytes", "d_eval_batches", "h_best", "g_tail_report", "e_words", "e_seeds",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", ORDERED)
def test_many_buckets_match_oracle(spark, con, monkeypatch, name):
    monkeypatch.setattr(O, "TARGET_ROWS_PER_BUCKET", 7)
    res = compare(entry.queries()[name](spark, SF_SMALL), con, entry.oracle_sql()[name])
    assert res["ok"], res
