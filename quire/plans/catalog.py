"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver tables under ``sf_dir`` and returns a lazy
DataFrame whose column names and types equal its SQL twin in ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import offsets as O
from quire.operators import pack as G
from quire.operators import token_files as A
from quire.plans import common as C
from quire.plans import params as P
from quire.session import shared_path
from quire.sources import registry as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    """Register a query under ``name``; each call starts a fresh query scope."""

    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            C.reset_query_scope()  # each query learns its own word model once
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        return run

    return deco


def packed(spark: SparkSession, sf_dir: str, drop_last: bool = True, ordered: bool = False) -> DataFrame:
    """Packed samples of the doc_id-ordered stream over SHARDS contiguous shards; with ``ordered`` its
    partitions are ranges of (shard, block)."""
    n = C.count_rows(spark, sf_dir, "documents")
    bucketing = O.position_bucketing("pos", n, spark)
    docs = C.table(spark, sf_dir, "documents")
    folder = A.new_folder(docs)
    if folder is None:
        blocks = G.pack_blocks(C.token_stream(spark, sf_dir), P.SEQ_LEN, bucketing, drop_last=drop_last)
        return blocks.repartitionByRange("shard", "block_id") if ordered else blocks
    found = A.write_ids(C.encode(spark, sf_dir, docs), folder)
    return A.pack_stored(found.join(C.positions(spark, sf_dir), "doc_id"), folder, P.SEQ_LEN, bucketing, drop_last=drop_last, ordered=ordered)


# --------------------------------------------------------------------------- E / F / G core


@register("e_words")
def e_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vocabulary (E4) as one lazy distributed plan."""
    from quire.operators import vocab as V

    return V.word_vocabulary(C.table(spark, sf_dir, "documents"), P.VOCAB_SIZE).select("id", "word", "cnt")


@register("f_encode")
def f_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word encode of every document with byte fallback (F1, F2)."""
    enc = C.encode(spark, sf_dir, C.table(spark, sf_dir, "documents"))
    return enc.select("doc_id", F.size("ids").alias("n_ids"), F.md5(T.ids_text(F.col("ids"))).alias("ids_md5"))


@register("g_pack")
def g_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed blocks of SEQ_LEN tokens per shard, labels pre-shifted, full masks."""
    b = packed(spark, sf_dir)
    return b.select(
        "shard",
        "block_id",
        T.ids_text(F.col("input_ids")).alias("input_ids"),
        T.ids_text(F.col("labels")).alias("labels"),
        T.ids_text(F.col("attention_mask")).alias("attention_mask"),
    )


@register("flagship")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> word vocabulary -> encode -> pack -> blocks per source genre."""
    b = packed(spark, sf_dir)
    docs = C.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("first_doc_id"),
        F.element_at(F.array(*[F.lit(g) for g in R.GENRES]), R.genre_index_expr() + 1).alias("genre"),
    )
    return b.join(docs, "first_doc_id").groupBy("genre").agg(F.count("*").alias("n_blocks"))


# --------------------------------------------------------------------------- A: sources


def _genre_col() -> F.Column:
    return F.element_at(F.array(*[F.lit(g) for g in R.GENRES]), R.genre_index_expr() + 1)


@register("a_registry")
def a_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows (A1) with the documents and characters each source offers."""
    reg = R.documents_registry(sf_dir)
    sizes = R.read_sources(spark, reg, reg.genres).groupBy("genre").agg(
        F.count("*").alias("n_docs"), F.sum(F.length("text")).cast("long").alias("n_chars")
    )
    specs = reg.to_frame(spark).select(
        "genre", "name", "text_column", F.array_join("available_splits", ",").alias("splits")
    )
    return specs.join(F.broadcast(sizes), "genre", "left")


@register("a_read_source")
def a_read_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source, one split, only its text column (A2, A3, B1)."""
    return R.read_source(spark, R.documents_registry(sf_dir), P.MIX_GENRE, "train")


@register("a_preview")
def a_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three rows of every source, 100-character previews (A5)."""
    reg = R.documents_registry(sf_dir)
    return R.preview(R.read_sources(spark, reg, reg.genres), 3, "Sample")


# --------------------------------------------------------------------------- C: mixing


@register("c_presets")
def c_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preset weights (C1) next to the documents each genre holds."""
    from quire.operators import mix as M

    reg = R.documents_registry(sf_dir)
    sizes = R.read_sources(spark, reg, reg.genres).groupBy("genre").agg(F.count("*").alias("n_docs"))
    return M.presets_frame(spark).join(F.broadcast(sizes), "genre", "left")


def _mixed(spark: SparkSession, sf_dir: str, strategy: str, payload: DataFrame | None = None) -> DataFrame:
    from quire.operators import mix as M

    reg = R.documents_registry(sf_dir)
    return M.mixed(spark, reg, M.recommended_mix(P.MIX_PRESET), seed=P.SEED, strategy=strategy, payload=payload)


@register("c_first")
def c_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced mix, stop at the first exhausted source."""
    return _mixed(spark, sf_dir, "first_exhausted").select("k", "genre", "doc_id")


@register("c_all")
def c_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced mix, stop when every source has been read once; exhausted sources restart (C4)."""
    return _mixed(spark, sf_dir, "all_exhausted").select("k", "genre", "doc_id")


@register("c_without_replacement")
def c_without_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced mix, exhausted sources are skipped; every row exactly once."""
    return _mixed(spark, sf_dir, "all_exhausted_without_replacement").select("k", "genre", "doc_id")


@register("c_single")
def c_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One named source in stream order, no draws."""
    from quire.operators import mix as M
    from quire.operators import order as D

    src = M.mixed(spark, R.documents_registry(sf_dir), P.SINGLE_GENRE, strategy="first_exhausted")
    return D.stream_positions(src.select("doc_id"), "doc_id").select("pos", "doc_id")


# --------------------------------------------------------------------------- D: order, shards, limits


def _shuffled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import order as D

    docs = C.table(spark, sf_dir, "documents").select("doc_id")
    return D.seeded_shuffle(docs, P.SEED, ["doc_id"], n_rows=C.count_rows(spark, sf_dir, "documents"), out="pos")


@register("d_shuffle")
def d_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded full shuffle after mixing (D1): the without-replacement mix, re-ordered."""
    from quire.operators import order as D

    mixed = _mixed(spark, sf_dir, "all_exhausted_without_replacement").select("k", "doc_id")
    n = C.count_rows(spark, sf_dir, "documents")  # without replacement: every document once
    return D.seeded_shuffle(mixed, P.SEED, ["doc_id", "k"], n_rows=n, out="spos").select("spos", "doc_id")


@register("d_block_shuffle")
def d_block_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffered shuffle in block form (D2) over the doc_id-ordered stream."""
    from quire.operators import order as D

    st = D.stream_positions(C.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return D.buffered_shuffle(st, P.SEED, P.SHUFFLE_BUFFER).select("spos", "doc_id")


@register("d_buffer_shuffle")
def d_buffer_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffered shuffle by the buffer's own law (D2) over the doc_id-ordered stream."""
    from quire.operators import order as D

    n = C.count_rows(spark, sf_dir, "documents")
    st = D.stream_positions(C.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", n_rows=n)
    return D.buffer_shuffle(st, P.SEED, P.SHUFFLE_BUFFER, n).select("spos", "doc_id")


@register("d_shard_contig")
def d_shard_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shards over 3 workers (D3)."""
    from quire.operators import order as D

    docs = C.table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    st = D.stream_positions(docs, "doc_id", n_rows=n)
    return st.select("doc_id", "pos", D.contiguous_shard(F.col("pos"), n, 3).alias("shard"))


@register("d_shard_mod")
def d_shard_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin shards over 3 workers."""
    from quire.operators import order as D

    st = D.stream_positions(C.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return st.select("doc_id", "pos", D.round_robin_shard(F.col("pos"), 3).alias("shard"))


@register("d_limit")
def d_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable rows only, then the first MAX_SAMPLES per shard (B2 before D5)."""
    from quire.operators import order as D

    usable = C.token_stream(spark, sf_dir)
    n = C.count_rows(spark, sf_dir, "documents")
    return D.per_shard_limit(usable, P.MAX_SAMPLES, n_rows=n).select("shard", "doc_id", F.col("shard_pos").cast("long").alias("shard_pos"))


@register("d_corpus_rows")
def d_corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus document cap over the shuffled stream."""
    from quire.operators import order as D

    return D.corpus_row_cap(_shuffled_docs(spark, sf_dir), P.MAX_DOCUMENTS).select("pos", "doc_id")


@register("d_corpus_bytes")
def d_corpus_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus byte cap, checked every BYTE_CHECK_EVERY rows (D7), on corpus lines (B3), with the
    row cap of BYTE_CAP_DOCUMENTS that the writer applies beside it (D6)."""
    from quire.operators import order as D

    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.octet_length(T.sentence_break(F.col("text"), P.TERMINATORS)).alias("nbytes"))
    n = C.count_rows(spark, sf_dir, "documents")
    sh = D.seeded_shuffle(docs, P.SEED, ["doc_id"], n_rows=n, out="pos")  # narrow rows: id and byte size
    bk = O.position_bucketing("pos", n, spark)
    capped = D.corpus_byte_cap(sh, P.MAX_BYTES, bk, max_documents=P.BYTE_CAP_DOCUMENTS, check_every=P.BYTE_CHECK_EVERY,
                               weight=F.col("nbytes"))
    return capped.select("pos", "doc_id", "cum_bytes")


def _eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation texts (benchmark) tokenized and truncated (F5), in item order, batched."""
    from quire.operators import encode as E
    from quire.operators import order as D

    bench = C.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    enc = C.encode(spark, sf_dir, bench)
    enc = enc.select(F.col("doc_id").alias("item_id"), E.truncate_single(F.col("ids"), P.EVAL_MAX_LEN).alias("ids"))
    enc = _stage(enc, shared_path(spark, "eval-rows"))  # ranked, then read: encoded once
    st = D.stream_positions(enc, "item_id", n_rows=C.count_rows(spark, sf_dir, "benchmark"))
    return st.withColumn("batch_id", F.floor(F.col("pos") / P.EVAL_BATCH).cast("long"))


@register("d_eval_batches")
def d_eval_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First MAX_EVAL_BATCHES batches (D8) and the fixed hold-out batch."""
    from quire.operators import order as D

    rows = D.first_batches(_eval_rows(spark, sf_dir), P.MAX_EVAL_BATCHES)
    return rows.select("item_id", "batch_id", D.is_holdout(F.col("batch_id")).alias("holdout"))


@register("d_every_nth")
def d_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows of every CHECKPOINT_INTERVAL-th step (D10); step = event id."""
    from quire.operators import order as D

    ev = C.table(spark, sf_dir, "events")
    return ev.where(D.every_nth(F.col("event_id"), P.CHECKPOINT_INTERVAL)).select(
        F.col("event_id").alias("step"), F.col("event_type").alias("tag"), "value"
    )


# --------------------------------------------------------------------------- B: text clean-up


@register("b_usable")
def b_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with text that gives tokens (B2), with their token counts."""
    from quire.operators import clean as B

    enc = C.encode(spark, sf_dir, C.table(spark, sf_dir, "documents"))
    return B.usable(enc).select("doc_id", F.size("ids").alias("n_tokens"))


@register("b_sentences")
def b_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All corpus lines after the sentence break."""
    from quire.operators import clean as B

    lines = B.sentence_lines(C.table(spark, sf_dir, "documents"), P.TERMINATORS)
    return lines.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line")


@register("b_trainer_lines")
def b_trainer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines the vocabulary trainer passes over for their length, counted (B4): unbroken texts, so that some are."""
    from quire.operators import clean as B

    lines = B.sentence_lines(C.table(spark, sf_dir, "documents"), ())
    kept, skipped = B.trainer_lines(lines)
    read = kept.agg(F.lit("read").alias("part"), F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length("line")), F.lit(0)).cast("long").alias("bytes"))
    passed = skipped.select(F.lit("skipped").alias("part"), F.col("skipped_lines").alias("lines"), F.col("skipped_bytes").alias("bytes"))
    return read.unionByName(passed)


@register("b_normalise")
def b_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity rule + custom table + whitespace steps."""
    from quire.operators import clean as B

    docs = C.table(spark, sf_dir, "documents")
    norm = B.normalise(F.col("text"), P.NORMALISE_RULES)
    return docs.select("doc_id", F.md5(norm).alias("norm_md5"), F.length(norm).alias("n_chars"))


@register("b_nfkc")
def b_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nmt_nfkc normalisation (B5, NFKC part) through an Arrow UDF; rows-only check."""
    from quire.operators import clean as B

    docs = C.table(spark, sf_dir, "documents")
    norm = B.normalise_by_rule(F.col("text"), "nmt_nfkc", T.CUSTOM_RULES)
    return docs.select("doc_id", F.md5(norm).alias("norm_md5"), F.length(norm).alias("n_chars"))


@register("b_prompt_crop")
def b_prompt_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EOS + prompt (B6), then the last CROP tokens (B7), for evaluation prompts."""
    from quire.operators import encode as E

    bench = C.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    enc = C.encode(spark, sf_dir, bench)
    ids = E.crop_last(E.prompt_frame(F.col("ids")), P.CROP)
    return enc.select(F.col("doc_id").alias("item_id"), T.ids_text(ids).alias("ids"))


# --------------------------------------------------------------------------- E: vocabularies


@register("e_alphabet")
def e_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters kept by coverage."""
    from quire.operators import vocab as V

    return V.alphabet(C.table(spark, sf_dir, "documents"), P.COVERAGE).select("ch", "cnt")


@register("e_chars")
def e_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character pieces with log-share scores."""
    from quire.operators import vocab as V

    cv = V.char_vocabulary(C.table(spark, sf_dir, "documents"), P.COVERAGE)
    return cv.select("id", "piece", F.round("score", 6).alias("score"))


@register("e_merges3")
def e_merges3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First BPE_MERGES pair merges (E5), exact order."""
    from quire.operators import vocab as V

    merges = V.bpe_merges(C.table(spark, sf_dir, "documents"), P.BPE_MERGES)
    return spark.createDataFrame(merges, "merge_idx int, l string, r string, cnt long")


@register("e_seeds")
def e_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram seed sub-strings (E6 seeds)."""
    from quire.operators import vocab as V

    return V.seed_pieces(C.table(spark, sf_dir, "documents"), P.SEED_PIECES, P.SEED_MAX_LEN)


@register("e_special")
def e_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole piece table (E7 layout): specials, bytes, learned words."""
    from quire.operators import vocab as V

    pt = V.word_piece_table(spark, C.table(spark, sf_dir, "documents"), P.VOCAB_SIZE)
    return pt.select("id", "piece", "type", F.round("score", 6).alias("score"))


@register("e_stats")
def e_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and total tokens per document."""
    from quire.operators import vocab as V

    return V.token_stats(C.encode(spark, sf_dir, C.table(spark, sf_dir, "documents")))


# --------------------------------------------------------------------------- F: tokenizer


def _bench_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = C.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return C.encode(spark, sf_dir, bench).withColumnRenamed("doc_id", "item_id")


@register("f_single")
def f_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-sequence template <s> $A </s> over evaluation texts."""
    from quire.operators import encode as E

    return _bench_ids(spark, sf_dir).select("item_id", T.ids_text(E.template_single(F.col("ids"))).alias("ids"))


@register("f_pair")
def f_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair template (F4): a user turn and the turn after it."""
    from quire.operators import encode as E

    conv = C.table(spark, sf_dir, "conversations")
    enc = C.encode(spark, sf_dir, conv, id_col="conv_id", keep=("turn", "role"))
    a = enc.where(F.col("role") == "user").select("conv_id", "turn", F.col("ids").alias("a"))
    b = enc.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("b"))
    ids, types = E.template_pair(F.col("a"), F.col("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", T.ids_text(ids).alias("ids"), T.ids_text(types).alias("type_ids"))


@register("f_truncate")
def f_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncation to SEQ_LEN including <s> and </s>."""
    from quire.operators import encode as E

    enc = C.encode(spark, sf_dir, C.table(spark, sf_dir, "documents"))
    return enc.select("doc_id", T.ids_text(E.truncate_single(F.col("ids"), P.SEQ_LEN)).alias("ids"))


@register("f_decode")
def f_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode of every encoded document, specials skipped."""
    from quire.operators import encode as E

    from quire.operators import vocab as V

    enc = C.encode(spark, sf_dir, C.table(spark, sf_dir, "documents"))
    dec = E.decode_ids(enc, C.pieces(spark, sf_dir), C.pieces_bound())
    return dec.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@register("f_pad_choice")
def f_pad_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pad id of the learned piece table."""
    from quire.operators import vocab as V

    return V.pad_choice(C.pieces(spark, sf_dir))


@register("f_chat")
def f_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat rendering (F8) and the token count of each rendered conversation."""
    from quire.operators import encode as E

    chats = E.render_chat(C.table(spark, sf_dir, "conversations"))
    enc = C.encode(spark, sf_dir, chats, id_col="conv_id", text_col="chat")
    return chats.join(enc, "conv_id").select(
        "conv_id", F.md5("chat").alias("chat_md5"), F.length("chat").alias("n_chars"), F.size("ids").alias("n_ids")
    )


# --------------------------------------------------------------------------- G: packing tail, batches, collation


@register("g_pack_tail")
def g_pack_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded tail block of every shard when drop_last is false."""
    b = packed(spark, sf_dir, drop_last=False).where("is_tail")
    return b.select(
        "shard",
        "block_id",
        T.ids_text(F.col("input_ids")).alias("input_ids"),
        T.ids_text(F.col("labels")).alias("labels"),
        T.ids_text(F.col("attention_mask")).alias("attention_mask"),
    )


@register("g_batches")
def g_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of BATCH_SIZE packed samples per shard (G6) and planned steps."""
    b = G.batches(packed(spark, sf_dir), P.BATCH_SIZE)
    sizes = b.groupBy("shard", "batch_id").agg(F.count("*").alias("n_samples"), F.max("block_id").alias("last"))
    # blocks are numbered from 0 without gaps: a shard's sample count is its last number + 1
    shards = sizes.groupBy("shard").agg((F.max("last") + 1).alias("n"))
    steps = shards.select("shard", G.total_steps(F.col("n"), P.BATCH_SIZE).alias("total_steps"))
    return sizes.drop("last").join(steps, "shard")


def _collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _eval_rows(spark, sf_dir).select("item_id", "batch_id", "ids")
    return G.collate(rows)


@register("g_collate")
def g_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pad to the longest row of each batch (G7), pad labels masked."""
    c = _collated(spark, sf_dir)
    return c.select(
        "item_id", "batch_id",
        T.ids_text(F.col("input_ids")).alias("input_ids"),
        T.ids_text(F.col("attention_mask")).alias("attention_mask"),
        T.ids_text(F.col("labels")).alias("labels"),
    )


@register("g_shift")
def g_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels shifted at use (G9) and the valid-token count (H6)."""
    c = _collated(spark, sf_dir)
    sh = G.shift_at_use(F.col("labels"))
    return c.select("item_id", "batch_id", T.ids_text(sh).alias("labels"), G.valid_tokens(sh).alias("n_valid"))


# --------------------------------------------------------------------------- H: scoring and metrics


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import lm as L

    return L.fit_bigram(C.encode(spark, sf_dir, C.table(spark, sf_dir, "documents")))


def _batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import evaluate as H
    from quire.operators import lm as L

    pairs = H.eval_pairs(_collated(spark, sf_dir))
    return L.score_pairs(pairs, _model(spark, sf_dir), P.ALPHA, C.pieces_bound(), ("batch_id",))


@register("h_bigram")
def h_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram counts and smoothed log-probabilities (H1)."""
    from quire.operators import lm as L

    m = L.with_log_prob(_model(spark, sf_dir), P.ALPHA, C.pieces_bound())
    return m.select("a", "b", F.col("cnt").cast("long").alias("cnt"), F.round("logp", 6).alias("logp"))


@register("h_batch_loss")
def h_batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean next-token loss of each evaluation batch over its valid tokens (H2)."""
    from quire.operators import evaluate as H

    return H.batch_loss(_batch_scores(spark, sf_dir)).select("batch_id", F.round("loss", 6).alias("loss"))


@register("h_update_loss")
def h_update_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of ACCUMULATE batch means per update; incomplete groups do not update (H3)."""
    from quire.operators import evaluate as H

    u = H.update_loss(H.batch_loss(_batch_scores(spark, sf_dir)), P.ACCUMULATE)
    return u.select("update_id", F.round("loss", 6).alias("loss"))


@register("h_logppl")
def h_logppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-perplexity over the first MAX_EVAL_BATCHES batches (H4), of the
    hold-out batch (H5), and the valid-token count (H6)."""
    from quire.operators import evaluate as H
    from quire.operators import order as D

    s = D.first_batches(_batch_scores(spark, sf_dir), P.MAX_EVAL_BATCHES)
    hold = D.is_holdout(F.col("batch_id"))
    agg = s.agg(
        F.sum("nll").alias("nll"), F.sum("n_tokens").alias("n"),
        F.sum(F.when(hold, F.col("nll"))).alias("nll0"), F.sum(F.when(hold, F.col("n_tokens"))).alias("n0"),
    )
    return agg.select(
        F.round(H.log_perplexity(F.col("nll"), F.col("n")), 6).alias("log_ppl"),
        F.round(H.log_perplexity(F.col("nll0"), F.col("n0")), 6).alias("const_log_ppl"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_valid"),
    )


def _event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = C.table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value")


@register("h_best")
def h_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-so-far flag per metric series (H7); events stand for the metric stream."""
    from quire.operators import evaluate as H

    m = _event_metrics(spark, sf_dir)
    bk = O.quantile_bucketing(m, "step")
    return H.best_so_far(m, bk).select("tag", "step", "value", "is_best")


@register("h_log")
def h_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows every step plus a validation row every CHECKPOINT_INTERVAL steps (H8)."""
    from quire.operators import evaluate as H

    train = C.table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), "value")
    log = H.metric_log(train, P.CHECKPOINT_INTERVAL)
    return log.select("step", "tag", F.round("value", 6).alias("value"))


@register("h_samples")
def h_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text samples of the metric log (A9, H8): the two first evaluation prompts at every checkpoint step."""
    from quire.operators import evaluate as H

    train = C.table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), "value")
    prompts = C.table(spark, sf_dir, "benchmark").where("item_id < 2")  # the run's two fixed prompts
    samples = prompts.select(F.lit(None).cast("long").alias("step"), F.col("item_id").alias("name"), F.substring("text", 1, 100).alias("text"))
    return H.sample_log(train, P.CHECKPOINT_INTERVAL, samples).select("step", "tag", "text")


@register("a_block_order")
def a_block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training blocks (A7) as a trainer gets them from the files in the manifest's order."""
    from quire.sources import sinks as K

    out = K.write_blocks(packed(spark, sf_dir, ordered=True), f"{shared_path(spark, 'ordered')}/blocks", ordered=True)
    rows = K.read_blocks(spark, out)
    return rows.select("shard", "place", "block_id", F.md5(T.ids_text(F.col("input_ids"))).alias("ids_md5"))


@register("a_metric_long")
def a_metric_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide per-batch evaluation scalars unpivoted to the long metric log."""
    from quire.operators import evaluate as H

    s = _batch_scores(spark, sf_dir).select(
        "batch_id", (F.col("nll") / F.col("n_tokens")).alias("loss"), F.col("n_tokens").cast("double").alias("tokens")
    )
    long = H.metric_long(s, "batch_id", {"loss": "Loss/Validation", "tokens": "Tokens/Validation"})
    return long.select("step", "tag", F.round("value", 6).alias("value"))


# --------------------------------------------------------------------------- I: candidate filters


@register("i_scores")
def i_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top SCORE_TOP_K items per context vector by normed inner product."""
    from quire.operators import candidates as I

    emb = C.table(spark, sf_dir, "embeddings")
    out = I.inner_product_top_k(emb, emb, P.SCORE_TOP_K)
    return out.select(F.col("vec_id").alias("ctx_id"), "rank", "item_id", F.round("score", 6).alias("score"))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation prompts framed with EOS (B6): ``(ctx_id, ids)``."""
    from quire.operators import encode as E

    bench = C.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    enc = C.encode(spark, sf_dir, bench)
    return enc.select(F.col("doc_id").alias("ctx_id"), E.prompt_frame(F.col("ids")).alias("ids"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-token logits of each prompt over the whole vocabulary under the bigram model,
    after the repetition penalty (I1). The observed successors of the prompt's last
    (cropped, B7) token and the prompt's own tokens have rows of their own; all other
    pieces share one logit and one row (``candidates.with_rest``). A context whose last
    token was never seen has the rest row only, besides its own tokens."""
    from quire.operators import candidates as I
    from quire.operators import encode as E
    from quire.operators import lm as L

    prompts = _prompts(spark, sf_dir)
    last = prompts.select("ctx_id", F.element_at(E.crop_last(F.col("ids"), P.CROP), -1).alias("a"))
    vocab = C.pieces_bound()
    last = _stage(last.join(prompts, "ctx_id"), shared_path(spark, "contexts"))
    seen = last.select("ctx_id", "a", F.explode(F.array_distinct("ids")).alias("token_id"))
    model = _model(spark, sf_dir)
    used = model.join(last.select("a").distinct(), "a", "left_semi")
    totals = L.context_totals(used)
    pairs = last.select("ctx_id", "a").join(used, "a").select("ctx_id", "a", F.col("b").alias("token_id"), "cnt")
    own = pairs.unionByName(seen.withColumn("cnt", F.lit(0).cast("long"))).groupBy("ctx_id", "a", "token_id").agg(F.max("cnt").alias("cnt"))
    own = own.join(totals, "a", "left").select("ctx_id", "token_id", L.log_prob(F.col("cnt"), F.col("ca"), P.ALPHA, vocab).alias("logit"))
    contexts = last.select("ctx_id", "a").join(totals, "a", "left")
    cands = I.with_rest(contexts, own, L.log_prob(F.lit(0), F.col("ca"), P.ALPHA, vocab), vocab)
    return I.repetition_penalty(cands, seen.select("ctx_id", "token_id"), P.PENALTY)


@register("i_penalty")
def i_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-token logits of every prompt after the repetition penalty (I1); token_id null: the n other pieces."""
    return _candidates(spark, sf_dir).select("ctx_id", "token_id", "n", F.round("logit", 6).alias("logit"))


@register("i_greedy")
def i_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy pick per context, ties to the lowest token id."""
    from quire.operators import candidates as I

    return I.greedy(_candidates(spark, sf_dir))


def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import candidates as I

    return I.top_k(I.temperature(_candidates(spark, sf_dir), P.TEMPERATURE), P.TOP_K)


@register("i_topk")
def i_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature (I3) then top-k keeping ties (I4)."""
    return _topk(spark, sf_dir).select("ctx_id", "token_id", "n", F.round("logit", 6).alias("logit"))


def _topp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import candidates as I

    return I.softmax(I.top_p(_topk(spark, sf_dir), P.TOP_P))


@register("i_topp")
def i_topp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nucleus filter (I5) and the renormalised softmax."""
    return _topp(spark, sf_dir).select("ctx_id", "token_id", "n", F.round("prob", 6).alias("prob"))


@register("i_draw")
def i_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seeded categorical draw per context."""
    from quire.operators import candidates as I

    return I.draw(_topp(spark, sf_dir), P.SEED)


@register("i_eos")
def i_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EOS propagation over packed rows and the length each batch runs to (I8)."""
    from quire.operators import candidates as I

    b = packed(spark, sf_dir).withColumn("batch_id", F.floor(F.col("block_id") / P.BATCH_SIZE).cast("long"))
    w = Window.partitionBy("shard", "batch_id")
    return b.select(
        "shard",
        "block_id",
        T.ids_text(I.propagate_eos(F.col("input_ids"))).alias("ids"),
        F.max(I.finished_length(F.col("input_ids"))).over(w).alias("batch_len"),
    )


# --------------------------------------------------------------------------- J: streaming, A4


def _stage(df: DataFrame, base: str) -> DataFrame:
    """Write once to the shared folder and read back (cuts lineage, survives executor loss)."""
    df.write.mode("overwrite").parquet(base)
    return df.sparkSession.read.parquet(base)


def _arrivals(staged: DataFrame, base: str, cut: F.Column, arrive: Callable[[DataFrame], None], n_chunks: int = 4) -> None:
    """``arrive`` for each of ``n_chunks`` arrivals of ``staged``; ``cut`` is the arrival a row comes with.

    An arrival is written by as many tasks as it takes, then the stream reads all that is new.
    """
    spark = staged.sparkSession
    for c in range(n_chunks):
        staged.where(cut == c).write.mode("append").parquet(f"{base}/source")
        arrive(spark.readStream.schema(staged.schema).parquet(f"{base}/source"))


def _quarter(staged: DataFrame, column: str, n_chunks: int = 4) -> F.Column:
    """Which of ``n_chunks`` equal ranges of ``column`` a row is in."""
    lo, hi = staged.agg(F.min(column), F.max(column)).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // n_chunks))
    return F.floor((F.col(column) - F.lit(lo or 0)) / F.lit(width))


@register("j_pack")
def j_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming pack over four arrivals, each with a part of every shard."""
    return _stream_packed(spark, sf_dir, None, True)


@register("j_pack_limit")
def j_pack_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming pack of the first MAX_SAMPLES documents of each shard, counted over arrivals
    (J3), with each shard's padded tail (J2)."""
    return _stream_packed(spark, sf_dir, P.MAX_SAMPLES, False)


def _stream_packed(spark: SparkSession, sf_dir: str, max_samples: int | None, drop_last: bool) -> DataFrame:
    from quire.streaming import pack_stream as J

    base = shared_path(spark, "jpack")
    staged = _stage(C.token_stream(spark, sf_dir).select("shard", "pos", "doc_id", "ids"), f"{base}/staged-source")
    # every arrival has a part of every shard: shards are ranges of pos, arrivals quarters of each shard
    bounds = staged.groupBy("shard").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    part = F.floor((F.col("pos") - F.col("lo")) * 4 / (F.col("hi") - F.col("lo") + 1))
    # a row of bounds per shard goes to every task: dealt by shard, the tokens would meet in one task per shard
    staged = staged.join(F.broadcast(bounds), "shard").withColumn("part", part).drop("lo", "hi")
    _arrivals(staged, base, F.col("part"), lambda src: J.pack_arrival(spark, src, P.SEQ_LEN, base, max_samples=max_samples))
    blocks = J.packed_blocks(spark, base, P.SEQ_LEN, drop_last=drop_last)
    return blocks.select(
        "shard", "block_id",
        T.ids_text(F.col("input_ids")).alias("input_ids"),
        T.ids_text(F.col("labels")).alias("labels"),
        T.ids_text(F.col("attention_mask")).alias("attention_mask"),
    )


@register("j_metrics")
def j_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming metric log with a best-so-far flag (J4): minima of step ranges, and the ledger's best per tag."""
    from quire.streaming import pack_stream as J

    base = shared_path(spark, "jmetrics")
    staged = _stage(_event_metrics(spark, sf_dir), f"{base}/staged-source")
    _arrivals(staged, base, _quarter(staged, "step"), lambda src: J.best_arrival(spark, src, base))
    return J.best_rows(spark, base)


@register("a_stream")
def a_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental read of a source (A4): file stream, text column only, parquet sink."""
    from quire.streaming import pack_stream as J

    base = shared_path(spark, "astream")
    # a file stream watches a folder or a glob; the glob names just this table
    glob = f"{sf_dir.rstrip('/')}/documents*.parquet"
    reg = R.SourceRegistry([R.SourceSpec(genre="all", path=glob)])
    src = R.stream_source(spark, reg, "all").select("doc_id", "text")
    J.run_available(spark, src, f"{base}/sink", f"{base}/checkpoint")
    return spark.read.schema(src.schema).parquet(f"{base}/sink").select("doc_id", F.length("text").alias("n_chars"))


# --------------------------------------------------------------------------- sinks, sub-word model


@register("a_sinks")
def a_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus text (A6), training blocks (A7) and piece table (A8) written to the
    shared folder and read back; per sink the row count and a checksum of the rows' contents."""
    from quire.sources import sinks as K

    base = shared_path(spark, "sinks")
    reg = R.documents_registry(sf_dir)
    lines = K.corpus_lines(spark, reg, max_documents=P.MAX_DOCUMENTS, max_bytes=P.MAX_BYTES, seed=P.SEED,
                           check_every=P.BYTE_CHECK_EVERY, terminators=P.TERMINATORS)
    K.write_corpus(lines, f"{base}/corpus")
    K.write_blocks(packed(spark, sf_dir, ordered=True), f"{base}/blocks", ordered=True)
    K.write_pieces(C.pieces(spark, sf_dir), f"{base}/pieces")
    corpus = spark.read.text(f"{base}/corpus").select(F.lit("corpus_lines").alias("sink"), F.col("value").alias("row"))
    blocks = spark.read.parquet(f"{base}/blocks").select(
        F.lit("blocks").alias("sink"),
        F.concat_ws("|", F.col("shard"), F.col("block_id"), T.ids_text(F.col("input_ids")), T.ids_text(F.col("labels"))).alias("row"),
    )
    pieces = spark.read.json(f"{base}/pieces/json").select(F.lit("pieces").alias("sink"), F.concat_ws("|", "id", "piece", "type").alias("row"))
    every = corpus.unionByName(blocks).unionByName(pieces)
    # 52 bits of every row's md5, summed: equal for equal sets of rows
    bits = F.conv(F.substring(F.md5("row"), 1, 13), 16, 10).cast("decimal(38,0)")
    return every.groupBy("sink").agg(F.count("*").alias("n_rows"), F.sum(bits).cast("string").alias("content"))


def _unigram(spark: SparkSession, sf_dir: str) -> list:
    from quire.operators import unigram as U

    docs = C.table(spark, sf_dir, "documents")
    return C.trained(spark, ("unigram", sf_dir), lambda: U.train_unigram(spark, docs, P.UNIGRAM_VOCAB, seed_size=P.UNIGRAM_SEEDS))


@register("e_unigram")
def e_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram sub-word vocabulary by EM over distinct words."""
    from quire.operators import unigram as U

    return U.unigram_piece_table(spark, _unigram(spark, sf_dir))


@register("e_unigram_summary")
def e_unigram_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unigram table in figures (E6): pieces, their probability mass, characters of the alphabet kept."""
    from quire.operators import unigram as U

    table = U.unigram_piece_table(spark, _unigram(spark, sf_dir))
    learned = F.col("type") == "NORMAL"
    return table.agg(
        F.count("*").alias("n_pieces"),
        F.round(F.sum(F.when(learned, F.exp("score"))), 6).alias("mass"),
        F.sum(F.when(learned & (F.length("piece") == 1), 1).otherwise(0)).cast("long").alias("n_characters"),
    )


@register("f_subword_text")
def f_subword_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded text of the sub-word encode (F1, F6): the words of every document, one blank between them."""
    from quire.operators import encode as E
    from quire.operators import unigram as U

    learned = _unigram(spark, sf_dir)
    enc = U.encode_subword(C.table(spark, sf_dir, "documents"), learned)
    dec = E.decode_ids(enc, U.unigram_piece_table(spark, learned), T.FIRST_LEARNED_ID + P.UNIGRAM_VOCAB)
    return dec.select("doc_id", F.md5("text").alias("text_md5"))


@register("g_loader_subword")
def g_loader_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loader with the sub-word encoder: tokens and blocks per worker; rows-only check."""
    from quire.operators import unigram as U
    from quire.plans import loader as L

    learned = _unigram(spark, sf_dir)
    out = L.pretrain_batches(
        spark, R.documents_registry(sf_dir), lambda df: U.encode_subword(df, learned, keep=("genre",)),
        batch_size=P.BATCH_SIZE, seq_length=P.SEQ_LEN, shuffle_seed=P.SEED, shuffle_buffer_size=P.SHUFFLE_BUFFER,
        stopping_strategy="all_exhausted_without_replacement", num_workers=P.SHARDS,
    )
    return out.groupBy("shard").agg(F.count("*").alias("n_blocks"), F.sum(F.size("input_ids")).cast("long").alias("n_tokens"))


@register("f_subword")
def f_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-word encode of every document with the learned unigram pieces (F1)."""
    from quire.operators import unigram as U

    enc = U.encode_subword(C.table(spark, sf_dir, "documents"), _unigram(spark, sf_dir))
    return enc.select("doc_id", F.size("ids").alias("n_ids"), F.md5(T.ids_text(F.col("ids"))).alias("ids_md5"))


# --------------------------------------------------------------------------- the loader chain


@register("g_loader")
def g_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pre-training loader end to end: balanced mix (all exhausted), buffered
    shuffle, contiguous shards, encode, pack and batch (C4, D2, D3, F1, G1–G6)."""
    from quire.plans import loader as L

    out = L.pretrain_batches(
        spark, R.documents_registry(sf_dir), lambda df: C.encode(spark, sf_dir, df, keep=("genre",)),
        batch_size=P.BATCH_SIZE, seq_length=P.SEQ_LEN, mix_preset=P.MIX_PRESET, shuffle_seed=P.SEED,
        shuffle_buffer_size=P.SHUFFLE_BUFFER, stopping_strategy="all_exhausted", num_workers=P.SHARDS,
    )
    return out.select(
        "shard", "batch_id", "block_id",
        T.ids_text(F.col("input_ids")).alias("input_ids"),
        T.ids_text(F.col("labels")).alias("labels"),
    )


@register("e_bpe")
def e_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full pair-merge vocabulary run (E5): alphabet plus BPE_FULL_MERGES merges."""
    from quire.operators import vocab as V

    return V.bpe_piece_table(spark, C.table(spark, sf_dir, "documents"), P.BPE_FULL_MERGES)


def _merge_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import vocab as V

    docs = C.table(spark, sf_dir, "documents")
    return C.trained(spark, ("merges", sf_dir), lambda: V.bpe_piece_table(spark, docs, P.BPE_VOCAB_MERGES))


def _merge_encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from quire.operators import merges as M

    pieces = _merge_pieces(spark, sf_dir)
    return pieces, M.encode_merges(C.table(spark, sf_dir, "documents"), pieces, MERGE_PIECES)


# the alphabet is bounded by the code points
MERGE_PIECES = T.FIRST_LEARNED_ID + P.BPE_VOCAB_MERGES + 0x110000


@register("e_bpe_vocabulary")
def e_bpe_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair-merge vocabulary of BPE_VOCAB_MERGES merges (E5), beyond what SQL can unroll; rows-only check."""
    return _merge_pieces(spark, sf_dir)


@register("f_bpe")
def f_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair-merge encode of every document with the learned merges (F1); rows-only check."""
    _, enc = _merge_encoded(spark, sf_dir)
    return enc.select("doc_id", F.size("ids").alias("n_ids"), F.md5(T.ids_text(F.col("ids"))).alias("ids_md5"))


@register("f_bpe_text")
def f_bpe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded text of the pair-merge encode (F1, F6): the words of every document, one blank between them."""
    from quire.operators import encode as E

    pieces, enc = _merge_encoded(spark, sf_dir)
    return E.decode_ids(enc, pieces, MERGE_PIECES).select("doc_id", F.md5("text").alias("text_md5"))


# --------------------------------------------------------------------------- reports asked for by the quirks table


@register("d_limit_global")
def d_limit_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample limit with a global scope: the first MAX_SAMPLES usable rows of the stream."""
    from quire.operators import order as D

    usable = C.token_stream(spark, sf_dir)
    n = C.count_rows(spark, sf_dir, "documents")
    return D.limit_samples(usable, P.MAX_SAMPLES, "global", n_rows=n).select("doc_id", "stream_pos")


@register("g_tail_report")
def g_tail_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per shard and the tail tokens a dropped last block loses."""
    return G.dropped_tail_tokens(C.token_stream(spark, sf_dir), P.SEQ_LEN)


@register("c_shares")
def c_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised document and token shares per genre of the all-exhausted mix."""
    from quire.operators import mix as M

    # every document is encoded once, however often the mix draws it
    enc = C.encode(spark, sf_dir, C.documents(spark, sf_dir), keep=("genre",))
    sizes = enc.select("doc_id", "genre", F.size("ids").alias("n_ids"))
    return M.realised_shares(_mixed(spark, sf_dir, "all_exhausted", sizes))


@register("g_loader_tail")
def g_loader_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loader over one genre without EOS, limited per worker, tails kept, incomplete batches dropped
    (C6, D5, G5, G6 with the loader's other options)."""
    from quire.plans import loader as L

    out = L.pretrain_batches(
        spark, R.documents_registry(sf_dir), lambda df: C.encode(spark, sf_dir, df, keep=("genre",)),
        genre=P.SINGLE_GENRE, batch_size=P.BATCH_SIZE, seq_length=P.SEQ_LEN, shuffle=False, num_workers=2,
        max_samples=P.LOADER_SAMPLES, add_eos_between_samples=False, drop_last_sample=False, drop_last_batch=True,
    )
    return out.select(
        "shard", "batch_id", "block_id",
        T.ids_text(F.col("input_ids")).alias("input_ids"),
        T.ids_text(F.col("labels")).alias("labels"),
    )


@register("c_choice")
def c_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a mix (C2) and of the trainer's options (E1): genre shares of the documents as weights are
    accepted; the same weights doubled, with a genre too many, or with an empty one are told what is wrong."""
    from quire.operators import mix as M
    from quire.operators import vocab as V
    from quire.options import OptionError

    reg = R.documents_registry(sf_dir)
    n = {r["genre"]: r["n"] for r in R.read_sources(spark, reg, reg.genres).groupBy("genre").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    shares = {g: c / total for g, c in sorted(n.items())}
    low = min(n.values())
    cases = [
        ("shares", lambda: M.Choice.of(reg, shares)),
        ("doubled", lambda: M.Choice.of(reg, {g: 2 * w for g, w in shares.items()})),
        ("unknown genre", lambda: M.Choice.of(reg, {**shares, "novel": 1 / total})),
        ("without documents", lambda: M.Choice.of(reg, {**shares, sorted(n)[0]: 0.0})),
        ("vocabulary", lambda: V.TrainingOptions(low, low / total)),
        ("all wrong", lambda: V.TrainingOptions(low - total, 1 + low, f"model {low}", " " * low)),
    ]
    rows = []
    for name, make in cases:
        try:
            make()
            rows.append((name, 0))
        except OptionError as e:
            rows.append((name, len(e.problems)))
    return spark.createDataFrame(rows, "case string, problems int")


@register("a_metric_append")
def a_metric_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to one metric log and read back (A9): training values per step under a
    learning-rate and a loss tag, and the constant evaluation loss."""
    from quire.operators import evaluate as H
    from quire.sources import sinks as K

    log = f"{shared_path(spark, 'metrics')}/log"
    ev = C.table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") / 1000).alias("rate"))
    K.append_metrics(H.metric_long(ev, "event_id", {"value": "Loss/Train", "rate": "Learning Rate"}, run="a"), log)
    at = ev.where(F.pmod(F.col("event_id") + 1, F.lit(P.CHECKPOINT_INTERVAL)) == 0)
    K.append_metrics(H.metric_long(at, "event_id", {"value": "Loss/ConstEval"}, run="b"), log)
    back = spark.read.parquet(log)
    return back.select("run", "step", "tag", F.round("value", 6).alias("value"))
