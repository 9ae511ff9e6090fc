"""Rows-only queries checked against brute force or round trips on small fixtures."""

import unicodedata

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import clean as B
from quire.operators import encode as E
from quire.operators import unigram as U
from quire.operators import vocab as V
from quire.plans import catalog as Q
from quire.plans import common as C
from quire.session import shared_path
from quire.sources import registry as R
from quire.sources import sinks as K
from tests.conftest import SF_SMALL


def test_subword_round_trip(spark):
    docs = C.table(spark, SF_SMALL, "documents").limit(60)  # a small fixture, not a query
    learned = U.train_unigram(spark, docs, 120, seed_size=300)
    enc = U.encode_subword(docs, learned)
    pieces = U.unigram_piece_table(spark, learned)
    dec = {r.doc_id: r.text for r in E.decode_ids(enc, pieces, 263 + len(learned)).collect()}
    want = {r.doc_id: r.t for r in docs.select("doc_id", T.collapse_whitespace(F.col("text")).alias("t")).collect()}
    assert dec == {k: v for k, v in want.items() if v}


def test_viterbi_is_best_path():
    scores = {"▁ab": -1.0, "▁a": -2.0, "b": -2.0, "▁": -3.0, "a": -3.0, "c": -4.0}
    ids = {p: 263 + i for i, p in enumerate(scores)}
    assert U._viterbi("▁ab", scores, ids, 16, -20.0) == [ids["▁ab"]]
    # brute force over all segmentations of a short word
    word = "▁abc"
    best, arg = None, None

    def walk(i, acc, path):
        nonlocal best, arg
        if i == len(word):
            if best is None or acc > best:
                best, arg = acc, path
            return
        for j in range(i + 1, len(word) + 1):
            p = word[i:j]
            if p in scores:
                walk(j, acc + scores[p], path + [ids[p]])

    walk(0, 0.0, [])
    assert U._viterbi(word, scores, ids, 16, -20.0) == arg


def test_bpe_run_starts_with_sql_checked_merges(spark):
    docs = C.table(spark, SF_SMALL, "documents")
    merges = V.bpe_merges(docs, 5)
    first3 = [(r.merge_idx, r.l, r.r, r.cnt) for r in Q.e_merges3(spark, SF_SMALL).orderBy("merge_idx").collect()]
    assert merges[:3] == first3


def test_nfkc_matches_python(spark):
    docs = C.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    got = {r.doc_id: r.n for r in docs.select("doc_id", B.nfkc_udf(F.col("text")).alias("n")).collect()}
    want = {r.doc_id: unicodedata.normalize("NFKC", r.text) for r in docs.collect()}
    assert got == want


def test_corpus_sink_reads_back(spark):
    reg = R.documents_registry(SF_SMALL)
    lines = K.corpus_lines(spark, reg, max_documents=150, max_bytes=10**9, seed=42)
    out = K.write_corpus(lines, shared_path(spark, "test-corpus"))
    written = spark.read.text(out).count()
    want = sum(r.body.count("\n") + 1 for r in lines.collect())
    assert written == want and lines.count() == 150


def test_stream_pack_limit_counts_per_shard(spark):
    # The per-shard sample counter matches the batch limit (B2 before D5)
    from quire.streaming import pack_stream as J

    st = C.token_stream(spark, SF_SMALL)
    base = shared_path(spark, "test-jlimit")
    st.write.parquet(f"{base}/src")
    J.pack_arrival(spark, spark.readStream.schema(st.schema).parquet(f"{base}/src"), 16, base, max_samples=5)
    blocks = J.packed_blocks(spark, base, 16, drop_last=False).collect()
    from quire.operators import order as D
    from quire.operators import offsets as O
    from quire.operators import pack as G

    lim = D.per_shard_limit(st, 5, n_rows=C.count_rows(spark, SF_SMALL, "documents")).drop("shard_pos")
    want = G.pack_blocks(lim, 16, O.dense_range_bucketing("pos", 0, 300, 1), drop_last=False).collect()
    norm = lambda rows: sorted((r.shard, r.block_id, list(r.input_ids), list(r.labels), list(r.attention_mask)) for r in rows)
    assert norm(blocks) == norm(want)


def test_train_vocabulary_entry_point(spark, tmp_path):
    import pytest

    reg = R.documents_registry(SF_SMALL)
    out = K.make_corpus(spark, reg, shared_path(spark, "test-vocab-corpus"), max_documents=80, max_bytes=10**9)
    rules = tmp_path / "rules.tsv"
    rules.write_text("«\t\"\n»\t\"\n", encoding="utf-8")
    for model_type, size in (("word", 400), ("char", 300), ("bpe", 400)):
        table = V.train_vocabulary(spark, out, size, model_type=model_type, normalization_rule_tsv=str(rules),
                                   normalization_rule_name="identity", merges=5)
        ids = [r.id for r in table.collect()]
        assert ids[:7] == list(range(7)) and len(ids) == len(set(ids)) and max(ids) < size
    with pytest.raises(ValueError):  # 263 fixed pieces + the alphabet do not fit in 300
        V.train_vocabulary(spark, out, 300, model_type="bpe", normalization_rule_name="identity", merges=5)
    with pytest.raises(FileNotFoundError):
        V.train_vocabulary(spark, "/nonexistent/corpus", 400, model_type="word")
    with pytest.raises(ValueError):
        V.train_vocabulary(spark, out, 99, model_type="word")


def test_batched_merges(spark):
    docs = C.table(spark, SF_SMALL, "documents")
    exact = V.bpe_merges(docs, 6)
    batched = V.bpe_merges(docs, 6, merges_per_round=3)
    assert len(batched) == 6
    assert batched[0] == exact[0]  # the best pair of the first round is the exact first merge
    # merges chosen in one round share no symbol
    for a in range(0, 6, 3):
        syms = [x for m in batched[a:a + 3] for x in (m[1], m[2])]
        assert len(syms) == len(set(syms))


def test_top_k_rows_against_brute_force():
    import numpy as np

    from quire.operators import candidates as I

    rng = np.random.default_rng(7)
    scores = rng.integers(0, 5, size=(40, 12)).astype(float)  # many ties, also at the cut-off
    ids = rng.permutation(100)[:12].astype(np.int64)
    rows, items, vals = I._top_k_rows(scores, ids, 3)
    got = {}
    for r, i, v in zip(rows, items, vals):
        got.setdefault(int(r), []).append((int(i), float(v)))
    for r in range(scores.shape[0]):
        want = sorted(zip(ids.tolist(), scores[r].tolist()), key=lambda t: (-t[1], t[0]))[:3]
        assert got[r] == want
