"""Pre-training loader: mix -> shuffle -> shard -> encode -> limit -> pack -> batch.

Counts, the encoded documents and the narrow stream rows are written while the plan is
built; the blocks are one DataFrame over those tables. Positions, the shuffle and the shards
are computed on narrow rows (draw, position, document id); every distinct
document is encoded once (an oversampling mix repeats documents many times) into files of the
shared folder, and the addresses of its tokens join the stream, salted for repeated documents.
A task that cuts a stretch of blocks reads its tokens from the files. Where the shared folder is
no mounted file system the token ids join the stream, and packing shuffles pieces by (shard, span of blocks).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import options
from quire.functions import text as T
from quire.operators import mix as M
from quire.operators import offsets as O
from quire.operators import order as D
from quire.operators import pack as G
from quire.operators import token_files as K
from quire.session import stored
from quire.sources import registry as R


def pretrain_batches(
    spark: SparkSession,
    registry: R.SourceRegistry,
    encode: Callable[[DataFrame], DataFrame],
    *,
    batch_size: int,
    seq_length: int,
    genre: str | Mapping[str, float] | None = None,
    mix_preset: str = "balanced",
    split: str = "train",
    shuffle: bool = True,
    shuffle_seed: int = 42,
    shuffle_buffer_size: int = 10_000,
    stopping_strategy: str = "all_exhausted",
    add_eos_between_samples: bool = True,
    max_samples: int | None = None,
    drop_last_sample: bool = True,
    num_workers: int = 0,
    drop_last_batch: bool = False,
    ignore_index: int = T.IGNORE_INDEX,
) -> DataFrame:
    """Batches of packed samples: ``(shard, batch_id, block_id, input_ids, labels, attention_mask)``.

    ``encode`` turns ``(doc_id, genre, text)`` rows into ``(doc_id, genre, ids)`` rows: the
    word encoder or the sub-word encoder, both of which leave out rows without tokens.
    ``num_workers`` workers each read a contiguous shard of the shuffled
    stream (0 means one reader); ``max_samples`` counts usable documents per
    shard, as a per-worker counter does.
    """
    options.check(
        batch_size=(batch_size, options.COUNT),
        seq_length=(seq_length, options.COUNT),
        num_workers=(num_workers, options.NOT_NEGATIVE),
        shuffle_buffer_size=(shuffle_buffer_size, options.COUNT),
        max_samples=(max_samples, options.COUNT_OR_NONE),
    )
    workers = num_workers or 1
    choice = M.Choice.of(registry, M.recommended_mix(mix_preset) if genre is None else genre, split, stopping_strategy)
    genres = list(choice.genres)
    sources = R.read_sources(spark, registry, genres, choice.split)
    if choice.weights is None:
        n = sources.count()
        ranked = D.stream_positions(sources.select("doc_id", "genre"), "doc_id", n_rows=n)
        plan = M.MixPlan(ranked.withColumn("salt", F.lit(0)), n, genres, [1])
    else:
        plan = M.interleave_plan(spark, sources, genres, list(choice.weights), seed=shuffle_seed, strategy=stopping_strategy)
    n, stream = plan.n, plan.rows

    # positions, shuffle and shards on narrow rows: (pos, genre, doc_id, salt)
    stream = stream.select("pos", "genre", "doc_id", "salt")
    if shuffle:
        stream = D.buffer_shuffle(stream, shuffle_seed, shuffle_buffer_size, n, pos_col="pos", out="spos")
        stream = stream.drop("pos").withColumnRenamed("spos", "pos")
    stream = stream.withColumn("shard", D.contiguous_shard(F.col("pos"), n, workers))

    # every distinct document is encoded once and written to the shared folder; documents without
    # tokens drop out at the join with their lengths, after sharding (B2 after D3)
    eos = 1 if add_eos_between_samples else 0
    tokens = encode(sources)
    folder = K.new_folder(tokens)
    if folder is not None:
        # addresses of the token arrays move, not the arrays: a mix repeats documents many times
        at = F.collect_list(F.struct("n", "file", "at")).alias("docs")
        found = K.write_ids(tokens, folder).groupBy("doc_id", "genre").agg(at)
        lengths = plan.attach(stream, found).withColumn("L", F.explode(F.transform("docs", lambda x: x["n"] + F.lit(eos))))
        keep = ("doc_id", "docs")
    else:
        encoded = stored(tokens, "loader-tokens")
        lengths = plan.attach(stream, encoded.select("doc_id", "genre", (F.size("ids") + F.lit(eos)).alias("L")))
        keep = ("genre", "doc_id", "salt")
    if max_samples is not None:
        lengths = D.per_shard_limit(lengths, max_samples, n_rows=n).drop("shard_pos")
    # narrow rows, written once: the running sums, the totals and the last join read them
    lengths = lengths.select("shard", "pos", *keep, "L").checkpoint(eager=True)
    offs = G.narrow_offsets(lengths, O.position_bucketing("pos", n, spark), keep=keep)
    total = lengths.agg(F.sum("L")).first()[0] or 0
    if folder is not None:
        rows = offs.withColumn("doc", F.explode("docs")).select("shard", "doc_id", "L", "start", "T", "doc.n", "doc.file", "doc.at")
        blocks = K.cut_stored(rows, folder, seq_length, total, add_eos=add_eos_between_samples, drop_last=drop_last_sample, ignore_index=ignore_index)
    else:
        # narrow rows look like work for one task, but each brings a document's tokens with the next
        # join: they are dealt by the number of tokens, which Spark cannot know
        offs = offs.repartition(max(spark.sparkContext.defaultParallelism, -(-total // K.TOKENS_PER_TASK)), "shard", "pos")
        # token ids that fit move as two bytes: a mix repeats documents, so their tokens are most of what is shuffled
        narrow = "smallint" if (encoded.agg(F.max(F.array_max("ids"))).first()[0] or 0) < 1 << 15 else "int"
        toks = F.concat("ids", F.array(F.lit(T.EOS_ID))) if add_eos_between_samples else F.col("ids")
        rows = plan.attach(offs, encoded.select("doc_id", "genre", toks.cast(f"array<{narrow}>").alias("toks")))
        blocks = G.cut_blocks(rows, seq_length, drop_last=drop_last_sample, ignore_index=ignore_index)
    return G.batches(blocks, batch_size, order_col="block_id", drop_last_batch=drop_last_batch).select(
        "shard", "batch_id", "block_id", "input_ids", "labels", "attention_mask"
    )
