"""Packing token streams into fixed blocks, batching and collation.

Packing follows the sequential buffer of a streaming packer in closed form:
per shard, documents are laid end to end (optionally with EOS after each);
block b takes stream tokens [b*S, b*S + S] (S+1 tokens: inputs are the first
S, labels the last S). Offsets come from the two-phase running sum, each
document is cut into the *pieces* that fall into the spans it touches
(one row per span of neighbouring blocks that it touches, never one row per token), and
pieces are re-assembled per (shard, span), a group of about SPAN_TOKENS tokens, and cut into blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import options
from quire.functions import text as T
from quire.operators import offsets as O
from quire.session import shared_path

SPAN_TOKENS = 1024  # of neighbouring blocks that are put together in one group

def stored_lengths(docs: DataFrame, add_eos: bool = True) -> tuple[DataFrame, DataFrame]:
    """The encoded documents written once to the shared folder, and their narrow ``(shard, pos, L)`` rows.

    The encoder upstream runs for this write only. Offsets, totals and the joins read the
    table: the first two its narrow columns, the last its token arrays.
    """
    path = shared_path(docs.sparkSession, "tokens")
    docs.write.parquet(path)
    stored = docs.sparkSession.read.schema(docs.schema).parquet(path)
    eos = 1 if add_eos else 0
    return stored, stored.select("shard", "pos", (F.size("ids") + F.lit(eos)).alias("L"))


def narrow_offsets(lengths: DataFrame, bucketing: O.Bucketing, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(shard, pos, *keep, L, start, T)`` from narrow ``(shard, pos, *keep, L)`` rows, where
    ``L`` already counts the EOS. The token arrays join afterwards, once.

    A shard's total comes with the bucket bases: a join on ``shard`` alone would leave the rows
    dealt by shard, and the blocks would then be put together with one task per shard."""
    offs = O.running_offsets(lengths, ["pos"], bucketing, partition_cols=("shard",),
                             weight=F.col("L"), out="start", total="T")
    return offs.select("shard", "pos", *keep, "L", "start", "T")


def pack_blocks(
    docs: DataFrame,
    seq_length: int,
    bucketing: O.Bucketing,
    *,
    add_eos: bool = True,
    drop_last: bool = True,
    eos_id: int = T.EOS_ID,
    pad_id: int = T.PAD_ID,
    ignore_index: int = T.IGNORE_INDEX,
) -> DataFrame:
    """Packed samples ``(shard, block_id, input_ids, labels, attention_mask, first_doc_id, is_tail)``.

    ``docs`` has ``shard, pos, doc_id, ids`` (already usable: non-empty ids).
    Full blocks per shard: ``max(0, (T-1) div S)``; the tail block (remainder
    r in 1..S) is kept only when ``drop_last`` is false and r > 1, padded with
    ``pad_id``, its mask has r ones and labels from r-1 on are ``ignore_index``.
    """
    options.check(seq_length=(seq_length, options.COUNT))
    docs, lengths = stored_lengths(docs, add_eos)
    offsets = narrow_offsets(lengths, bucketing)
    toks = F.concat("ids", F.array(F.lit(eos_id))) if add_eos else F.col("ids")
    rows = docs.select("shard", "pos", "doc_id", toks.alias("toks")).join(offsets, ["shard", "pos"])
    return cut_blocks(rows, seq_length, drop_last=drop_last, pad_id=pad_id, ignore_index=ignore_index)


def last_block_of(seq_length: int, drop_last: bool) -> tuple[Column, Column]:
    """Of a shard with ``T`` tokens: the number of full blocks, which is the tail's id, and the id of the last block kept."""
    S = seq_length
    nb = F.greatest(F.floor((F.col("T") - 1) / S), F.lit(0)).cast("long")
    # the tail block exists only when its remainder exceeds one token
    return nb, nb - 1 if drop_last else F.when(F.col("T") - nb * S > 1, nb).otherwise(nb - 1)


def cut_blocks(
    d: DataFrame,
    seq_length: int,
    *,
    drop_last: bool = True,
    pad_id: int = T.PAD_ID,
    ignore_index: int = T.IGNORE_INDEX,
) -> DataFrame:
    """Cut documents with stream offsets (``shard, doc_id, toks, L, start, T``)
    into packed samples; see :func:`pack_blocks`."""
    options.check(seq_length=(seq_length, options.COUNT))
    S = seq_length
    nb, last_block = last_block_of(S, drop_last)
    d = d.withColumn("nb", nb)
    d = d.withColumn("end", F.col("start") + F.col("L") - 1)
    lo = F.greatest(F.floor((F.col("start") - 1) / S), F.lit(0)).cast("long")
    hi = F.least(F.floor(F.col("end") / S).cast("long"), last_block)
    d = d.withColumn("lo", lo).withColumn("hi", hi).where(F.col("hi") >= F.col("lo"))
    # documents travel in spans of neighbouring blocks, not block by block: few rows, and a token moves once
    K = max(1, SPAN_TOKENS // S)
    pieces = d.select(
        "shard", "doc_id", "start", "end", "toks", "nb", "T",
        F.explode(F.sequence(F.floor(F.col("lo") / K), F.floor(F.col("hi") / K))).alias("span"),
    )
    s0 = F.col("span") * (K * S)
    p_from = F.greatest(F.col("start"), s0)
    p_to = F.least(F.col("end"), s0 + K * S)
    pieces = pieces.select(
        "shard", "span", "nb", "T",
        F.struct(
            p_from.alias("at"),
            F.col("doc_id"),
            F.slice("toks", (p_from - F.col("start") + 1).cast("int"), (p_to - p_from + 1).cast("int")).alias("t"),
        ).alias("pc"),
    )
    spans = pieces.groupBy("shard", "span", "nb", "T").agg(F.collect_list("pc").alias("pcs"))
    in_span = F.sequence(F.col("span") * K, F.least(F.col("span") * K + (K - 1), last_block))
    blocks = spans.select("shard", "nb", "T", "pcs", F.explode(in_span).alias("block_id"))
    b0 = F.col("block_id") * S

    def in_block(x: Column) -> Column:
        begin = F.greatest(x["at"], b0)
        n = F.least(x["at"] + F.size(x["t"]) - 1, b0 + S) - begin + 1
        return F.struct(begin.alias("at"), x["doc_id"].alias("doc_id"), F.slice(x["t"], (begin - x["at"] + 1).cast("int"), n.cast("int")).alias("t"))

    touching = F.filter("pcs", lambda x: (x["at"] <= b0 + S) & (x["at"] + F.size(x["t"]) > b0))
    blocks = blocks.select("shard", "block_id", "nb", "T", F.array_sort(F.transform(touching, in_block)).alias("pcs"))
    buf = F.flatten(F.transform("pcs", lambda x: x["t"])).cast("array<int>")
    blocks = blocks.select(
        "shard", "block_id", "nb", "T", buf.alias("buf"), F.col("pcs")[0]["doc_id"].alias("first_doc_id")
    )
    is_tail = F.col("block_id") == F.col("nb")
    r = (F.col("T") - F.col("nb") * S).cast("int")
    padded = F.concat("buf", F.array_repeat(F.lit(pad_id), F.lit(S + 1) - F.size("buf")))
    tail_labels = F.transform(
        F.slice(padded, 2, S), lambda x, i: F.when(i >= r - 1, F.lit(ignore_index)).otherwise(x)
    )
    tail_mask = F.transform(F.sequence(F.lit(0), F.lit(S - 1)), lambda i: F.when(i < r, 1).otherwise(0))
    return blocks.select(
        "shard",
        "block_id",
        F.when(is_tail, F.slice(padded, 1, S)).otherwise(F.slice("buf", 1, S)).alias("input_ids"),
        F.when(is_tail, tail_labels).otherwise(F.slice("buf", 2, S)).alias("labels"),
        F.when(is_tail, tail_mask).otherwise(F.array_repeat(F.lit(1), S)).cast("array<tinyint>").alias("attention_mask"),
        "first_doc_id",
        is_tail.alias("is_tail"),
    )


def dropped_tail_tokens(docs: DataFrame, seq_length: int, *, add_eos: bool = True) -> DataFrame:
    """Per shard: stream tokens and the tokens left after the last full block,
    which ``drop_last`` discards (one buffer per worker loses its tail)."""
    S = seq_length
    eos = 1 if add_eos else 0
    tot = docs.groupBy("shard").agg(F.sum(F.size("ids") + eos).alias("tokens"))
    nb = F.greatest(F.floor((F.col("tokens") - 1) / S), F.lit(0)).cast("long")
    return tot.select("shard", F.col("tokens").cast("long").alias("tokens"), (F.col("tokens") - nb * S).cast("long").alias("dropped"))


def batches(samples: DataFrame, batch_size: int, order_col: str = "block_id", drop_last_batch: bool = False) -> DataFrame:
    """Consecutive ``batch_size`` samples per shard form one batch.

    ``order_col`` is a dense 0-based position inside the shard, so the batch
    id is plain integer division; batch sizes come from one aggregate.
    """
    options.check(batch_size=(batch_size, options.COUNT))
    b = samples.withColumn("batch_id", F.floor(F.col(order_col) / batch_size).cast("long"))
    if drop_last_batch:
        sizes = b.groupBy("shard", "batch_id").agg(F.count("*").alias("n"))
        full = sizes.where(F.col("n") == batch_size).select("shard", "batch_id")
        b = b.join(full, ["shard", "batch_id"], "left_semi")
    return b


def total_steps(n_samples: Column, batch_size: int) -> Column:
    """Planned optimizer steps from a sample count."""
    return F.floor(n_samples / batch_size).cast("long")


def collate(rows: DataFrame, pad_id: int = T.PAD_ID, ids_col: str = "ids", batch_col: str = "batch_id") -> DataFrame:
    """Pad every row to its batch's longest row (G7) and mask pad labels.

    The batch maximum is a window over one batch (a bounded group).
    """
    longest = F.max(F.size(ids_col)).over(Window.partitionBy(batch_col))
    out = rows.withColumn("__n", F.size(ids_col)).withColumn("__m", longest)
    pad = F.array_repeat(F.lit(pad_id), (F.col("__m") - F.col("__n")).cast("int"))
    padded = F.concat(F.col(ids_col), pad)
    mask = F.concat(F.array_repeat(F.lit(1), F.col("__n").cast("int")), F.array_repeat(F.lit(0), (F.col("__m") - F.col("__n")).cast("int")))
    return out.select(
        *[c for c in rows.columns if c != ids_col],
        padded.alias("input_ids"),
        mask.alias("attention_mask"),
        F.transform(padded, lambda x: F.when(x == pad_id, F.lit(T.IGNORE_INDEX)).otherwise(x)).alias("labels"),
    )


def shift_at_use(labels: Column) -> Column:
    """Labels shifted at the loss (G9): drop the first position."""
    return F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))


def valid_tokens(labels: Column, ignore_index: int = T.IGNORE_INDEX) -> Column:
    """Count of labels that are not the ignore marker (H6)."""
    return F.size(F.filter(labels, lambda x: x != ignore_index))
