"""Order, shuffle, shards and limits (D1–D10) as ranks instead of a sequential index.

Every "n-th row of the stream" of a sequential loader becomes a 0-based
position column computed with the two-phase primitive of ``offsets``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import options
from quire.functions import text as T
from quire.operators import offsets as O
from quire.session import stored


def stream_positions(df: DataFrame, order_col: str = "doc_id", n_rows: int | None = None, out: str = "pos") -> DataFrame:
    """Dense 0-based position by a unique id column (quantile buckets)."""
    return O.global_positions(df, [order_col], O.quantile_bucketing(df, order_col, n_rows), out=out)


def seeded_shuffle(df: DataFrame, seed: int, key_cols: list[str], *, n_rows: int | None = None, out: str = "pos") -> DataFrame:
    """Full seeded shuffle (D1): order by md5(seed:key...), ranks from hash-prefix buckets."""
    if n_rows is None:
        n_rows = df.count()
    h = df.withColumn("__h", T.hash_key(seed, *key_cols))
    bk = O.hash_prefix_bucketing("__h", O.digits_for_rows(n_rows))
    return O.global_positions(h, ["__h", *key_cols], bk, out=out).drop("__h")


def buffered_shuffle(df: DataFrame, seed: int, buffer_size: int, pos_col: str = "pos", key_cols: tuple[str, ...] = ("doc_id",), out: str = "spos") -> DataFrame:
    """Block form of a buffered shuffle (D2): rows keep their block ``pos div buffer``
    and are hash-ordered inside it, so no row moves ``buffer`` places or more.

    Blocks are contiguous position ranges of equal size, so the global rank is
    closed form: ``block * buffer + rank inside the block`` (a window over one
    block, a bounded group).
    """
    options.check(buffer_size=(buffer_size, options.COUNT))
    blk = F.floor(F.col(pos_col) / buffer_size).cast("long")
    h = df.withColumn("__blk", blk).withColumn("__h", T.hash_key(seed, *key_cols, pos_col))
    w = Window.partitionBy("__blk").orderBy("__h", pos_col)
    return h.withColumn(out, F.col("__blk") * buffer_size + F.row_number().over(w) - 1).drop("__blk", "__h")


def slot_of(step: Column, seed: int, buffer_size: int) -> Column:
    """The buffer slot that is emptied at ``step`` (0-based): a hash of seed and step."""
    return F.conv(F.substring(T.hash_key(seed, F.lit("slot"), step), 1, 13), 16, 10).cast("long") % F.lit(buffer_size)


def buffer_shuffle(df: DataFrame, seed: int, buffer_size: int, n_rows: int, pos_col: str = "pos",
                   key_cols: tuple[str, ...] = ("doc_id",), out: str = "spos") -> DataFrame:
    """The shuffle buffer's own law (D2), without a buffer. ``pos_col`` is dense in [0, n_rows).

    The first ``buffer_size`` rows fill the buffer; then every further row takes a random slot
    and what was there comes out; in the end the rest comes out in hash order. Row p is in slot
    p, or, for p >= buffer_size, in the slot drawn at step p - buffer_size. It comes out at the
    step when its slot is drawn next, which is where the slot's next row enters: ``lead`` per
    slot. A row can come out at most buffer_size - 1 places early, and any number late.

    ``lead`` runs per (slot, range of positions), with a table of each range's first rows for
    what crosses ranges, so a small buffer does not leave few tasks.
    """
    options.check(buffer_size=(buffer_size, options.COUNT))
    pos = F.col(pos_col)
    rows = df.withColumn("__slot", F.when(pos < buffer_size, pos).otherwise(slot_of(pos - buffer_size, seed, buffer_size)))
    rows = O.position_bucketing(pos_col, n_rows, df.sparkSession).apply(rows)
    first = rows.groupBy("__slot", "__b").agg(F.min(pos_col).alias("__first"))
    later = first.select("__slot", "__b", F.lead("__first").over(Window.partitionBy("__slot").orderBy("__b")).alias("__later"))
    inside = F.lead(pos_col).over(Window.partitionBy("__slot", "__b").orderBy(pos_col))
    rows = rows.join(later, ["__slot", "__b"]).withColumn("__next", F.coalesce(inside, F.col("__later")))
    rows = stored(rows.drop("__slot", "__b", "__later"), "buffer")
    moved = rows.where(F.col("__next").isNotNull()).withColumn(out, F.col("__next") - buffer_size)
    # what stays to the end is the buffer: at most buffer_size rows
    rank = F.row_number().over(Window.orderBy(T.hash_key(seed, *key_cols, pos_col), pos_col))
    rest = rows.where(F.col("__next").isNull()).withColumn(out, F.lit(max(0, n_rows - buffer_size)) + rank - 1)
    return moved.unionByName(rest).withColumn(out, F.col(out).cast("long")).drop("__next")


def contiguous_shard(pos: Column, n: int, w: int) -> Column:
    """Contiguous shards (D3): the first ``n mod w`` shards take one extra row."""
    options.check(shards=(w, options.COUNT))
    q, r = divmod(n, w)
    big = r * (q + 1)
    if q == 0:
        return F.floor(pos / F.lit(q + 1)).cast("int")
    return F.when(pos < big, F.floor(pos / F.lit(q + 1))).otherwise(F.lit(r) + F.floor((pos - F.lit(big)) / F.lit(q))).cast("int")


def round_robin_shard(pos: Column, w: int) -> Column:
    """Round-robin shards (D4): arrival index modulo the number of workers."""
    options.check(shards=(w, options.COUNT))
    return F.pmod(pos, F.lit(w)).cast("int")


def per_shard_limit(
    df: DataFrame,
    max_samples: int,
    order_col: str = "pos",
    shard_col: str = "shard",
    *,
    bucketing: O.Bucketing | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Keep the first ``max_samples`` usable rows of each shard (D5, per-worker counter).

    The position inside the shard comes from the two-phase running count, so
    a shard (a whole worker's share of the stream) is never sorted in one
    task. Without an explicit bucketing, positions in ``[0, n_rows)`` get
    equal-width buckets (no extra job); otherwise quantiles of ``order_col``.
    """
    options.check(max_samples=(max_samples, options.COUNT))
    if bucketing is not None:
        bk = bucketing
    elif n_rows is not None:
        bk = O.position_bucketing(order_col, n_rows, df.sparkSession)
    else:
        bk = O.quantile_bucketing(df, order_col)
    ranked = O.global_positions(df, [order_col], bk, partition_cols=(shard_col,), out="shard_pos")
    return ranked.where(F.col("shard_pos") < max_samples)


def global_limit(df: DataFrame, max_samples: int, order_col: str = "pos", *, n_rows: int | None = None) -> DataFrame:
    """Keep the first ``max_samples`` usable rows of the whole stream (D5 with a global scope)."""
    options.check(max_samples=(max_samples, options.COUNT))
    if n_rows is not None:
        bk = O.position_bucketing(order_col, n_rows, df.sparkSession)
    else:
        bk = O.quantile_bucketing(df, order_col)
    return O.global_positions(df, [order_col], bk, out="stream_pos").where(F.col("stream_pos") < max_samples)


def limit_samples(df: DataFrame, max_samples: int, scope: str = "shard", **kw) -> DataFrame:
    """Sample limit with the counter per shard (the reference's per-worker count) or global."""
    options.check(scope=(scope, options.one_of(("shard", "global"))))
    if scope == "global":
        return global_limit(df, max_samples, n_rows=kw.get("n_rows"))
    return per_shard_limit(df, max_samples, **kw)


def corpus_row_cap(df: DataFrame, max_documents: int, pos_col: str = "pos") -> DataFrame:
    """Corpus row cap (D6): documents with position below the cap."""
    options.check(max_documents=(max_documents, options.COUNT))
    return df.where(F.col(pos_col) < max_documents)


def corpus_byte_cap(
    df: DataFrame,
    max_bytes: int,
    bucketing: O.Bucketing,
    *,
    max_documents: int | None = None,
    check_every: int = 1000,
    pos_col: str = "pos",
    line_col: str = "line",
    weight: Column | None = None,
) -> DataFrame:
    """Corpus byte cap (D7), exact: after writing row i the writer stops when
    i+1 reaches the row cap, or when ``i % check_every == 0`` and the bytes
    written so far reach ``max_bytes``. Rows up to the first such i are kept.

    Running byte totals come from the two-phase running sum over the (narrow)
    rows given; they are checkpointed to the shared folder once, the stop row
    is read from that table, and the rows are cut with a literal, so the chain
    that produced the rows runs once.
    """
    options.check(max_bytes=(max_bytes, options.COUNT))
    w = weight if weight is not None else F.octet_length(line_col)
    sized = O.running_offsets(df, [pos_col], bucketing, weight=w, out="cum_bytes", inclusive=True).checkpoint(eager=True)
    stop_at_bytes = (F.pmod(F.col(pos_col), F.lit(check_every)) == 0) & (F.col("cum_bytes") >= max_bytes)
    stop = sized.where(stop_at_bytes).agg(F.min(pos_col)).first()[0]
    keep = F.lit(True) if stop is None else F.col(pos_col) <= F.lit(int(stop))
    if max_documents is not None:
        keep = keep & (F.col(pos_col) < max_documents)
    return sized.where(keep)


def first_batches(df: DataFrame, n_batches: int = 30, batch_col: str = "batch_id") -> DataFrame:
    """Evaluation uses at most the first ``n_batches`` batches."""
    return df.where(F.col(batch_col) < n_batches)


def is_holdout(batch: Column) -> Column:
    """The fixed first batch reused for every evaluation."""
    return batch == 0


def every_nth(step: Column, n: int) -> Column:
    """Every n-th step, counting from 1."""
    return F.pmod(step + 1, F.lit(n)) == 0
