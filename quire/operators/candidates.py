"""Next-token candidate filters (I0–I8) as group-wise operators.

Input rows are ``(ctx_id, token_id, logit)``: one decoding step for many
contexts at once. Every window is partitioned by ``ctx_id``; a context holds
at most one row per vocabulary entry, so each group is bounded by the
vocabulary size. Pieces without a logit of their own can stand as one row (:func:`with_rest`). Filters run in the reference's order: penalty, then greedy
pick, or temperature -> top-k -> top-p -> softmax -> draw.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import options
from quire.functions import text as T
from quire.session import small_batches, stored

RMS_EPS = 1e-6
ROUNDING = 1e-9  # relative room of the norm bounds


# --------------------------------------------------------------------------- I0


def _top_k_rows(scores: np.ndarray, ids: np.ndarray, kk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact top-``kk`` per row of a score matrix, ties broken by item id.

    Rows whose k-th value is not tied are done for the whole batch at once
    (partition, then a two-key sort of the kk survivors); rows with ties at the
    cut-off take the per-row path, where every item at or above the k-th value
    competes. Returns (row index, item id, score) arrays, rank order per row.
    """
    n = scores.shape[1]
    kth = np.partition(scores, n - kk, axis=1)[:, n - kk]
    mask = scores >= kth[:, None]
    simple = mask.sum(axis=1) == kk
    rows_out, items_out, scores_out = [], [], []
    if simple.any():
        rix = np.nonzero(simple)[0]
        cols = np.nonzero(mask[simple])[1].reshape(-1, kk)
        sc = np.take_along_axis(scores[simple], cols, axis=1)
        order = np.lexsort((ids[cols], -sc), axis=1)
        rows_out.append(np.repeat(rix, kk))
        items_out.append(ids[np.take_along_axis(cols, order, axis=1)].ravel())
        scores_out.append(np.take_along_axis(sc, order, axis=1).ravel())
    for r in np.nonzero(~simple)[0]:
        cand = np.nonzero(mask[r])[0]
        order = cand[np.lexsort((ids[cand], -scores[r, cand]))][:kk]
        rows_out.append(np.full(len(order), r))
        items_out.append(ids[order])
        scores_out.append(scores[r, order])
    if not rows_out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return np.concatenate(rows_out), np.concatenate(items_out), np.concatenate(scores_out)


def _usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)`` of the rows with an id and a vector of finite numbers: the others have no score."""
    whole = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & F.coalesce(whole, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def _matrix(vectors: pa.Array, n: int) -> np.ndarray:
    return np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1), np.float64)


def _context_blocks(rows: DataFrame, n: int, block: int) -> DataFrame:
    """``(cb, ci, cv)``: one row per block of contexts, dealt by hash and packed on the executors."""
    blocks = max(1, -(-n // block))
    # a partition for each block: the blocks are then stored in files enough for many tasks
    dealt = rows.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(blocks, "cb")

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        v = _matrix(t.column("v").combine_chunks(), t.num_rows)
        return pa.table({
            "cb": pa.array([key[0].as_py()], pa.int32()), "ci": pa.array([t.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "cv": pa.array([v.tobytes()], pa.binary()),
        })

    return dealt.groupBy("cb").applyInArrow(pack, "cb int, ci binary, cv binary")


def norm_blocks(rows: DataFrame, n: int, block: int) -> DataFrame:
    """``(ib, part, ii, iv, top)``: items in blocks of falling norm, ``top`` the largest norm of a part.

    Blocks are ranges of (norm, hash of the id), so equal norms are dealt over blocks too; a
    block that came out larger than ``block`` rows has several parts.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    order = [F.desc("norm"), F.xxhash64("id")]
    dealt = rows.withColumn("norm", norm).repartitionByRange(max(1, -(-n // block)), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ib, part = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, block):
                some = b.slice(at, block)
                yield pa.record_batch(
                    [pa.array([ib], pa.int32()), pa.array([part], pa.int32()),
                     pa.array([some.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()),
                     pa.array([_matrix(some.column(1), some.num_rows).tobytes()], pa.binary()),
                     pa.array([float(np.max(some.column(2).to_numpy()))], pa.float64())],
                    names=["ib", "part", "ii", "iv", "top"],
                )
                part += 1

    return dealt.mapInArrow(pack, "ib int, part int, ii binary, iv binary, top double")


def _normed(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    ctx = np.frombuffer(ids, np.int64)
    x = np.frombuffer(vectors, np.float64).reshape(len(ctx), -1)
    return ctx, x / np.sqrt(np.mean(x * x, axis=1, keepdims=True) + RMS_EPS)


def head_block(blocks: DataFrame, rows: int) -> DataFrame:
    """``(ii, iv, top)``: about ``rows`` items of the largest norms as one row, whatever the size of the parts."""
    size = blocks.agg(F.count("*").alias("parts"), F.sum(F.octet_length("ii") / 8).alias("items")).first()
    n = max(1, math.ceil(rows * size["parts"] / size["items"])) if size["parts"] else 1

    def join(key: tuple, t: pa.Table) -> pa.Table:
        whole = [pa.array([b"".join(t.column(c).to_pylist())], pa.binary()) for c in ("ii", "iv")]
        return pa.table({"ii": whole[0], "iv": whole[1], "top": pa.array([max(t.column("top").to_pylist())], pa.float64())})

    first = blocks.orderBy("ib", "part").limit(n).select(F.least("part", F.lit(0)).alias("one"), "ii", "iv", "top")
    return first.groupBy("one").applyInArrow(join, "ii binary, iv binary, top double")


def with_bars(contexts: DataFrame, head: DataFrame, k: int) -> DataFrame:
    """Context blocks with ``bars``, a lower bound of each context's k-th score, and ``least``, the norm
    under which no item reaches any of them. ``head`` is one row of items of the largest norms."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                _, xn = _normed(r["ci"], r["cv"])
                y = np.frombuffer(r["iv"], np.float64).reshape(len(r["ii"]) // 8, -1)
                norm = np.linalg.norm(xn, axis=1)
                bars = np.full(len(xn), -np.inf)
                if len(y) >= k:
                    # room for the rounding of products of these lengths; items that tie with the k-th still count
                    bars = np.partition(xn @ y.T, len(y) - k, axis=1)[:, len(y) - k] - ROUNDING * norm * r["top"]
                least = np.divide(bars, norm, out=np.full(len(xn), -np.inf), where=norm > 0).min(initial=np.inf)
                yield pa.record_batch(
                    [pa.array([r["cb"]], pa.int32()), pa.array([r["ci"]], pa.binary()), pa.array([r["cv"]], pa.binary()),
                     pa.array([bars.tobytes()], pa.binary()), pa.array([least], pa.float64())],
                    names=["cb", "ci", "cv", "bars", "least"],
                )

    met = contexts.withColumn("one", F.lit(0)).join(F.broadcast(head.withColumn("one", F.lit(0))), "one")  # one block: bounded
    return met.select("cb", "ci", "cv", "ii", "iv", "top").mapInArrow(bound, "cb int, ci binary, cv binary, bars binary, least double")


def needed_tiles(contexts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Context blocks beside the item blocks whose largest norm can reach one of their bars.

    A join on a comparison: Spark pairs the partitions of both sides, which every task reads where
    they are stored, or sends a small side to all tasks. No block is shuffled per pair."""
    return contexts.join(blocks, blocks["top"] * (1 + ROUNDING) >= contexts["least"])


class _Best:
    """The best k items so far of every context of a block."""

    def __init__(self, ids: bytes, vectors: bytes, bars: bytes, k: int):
        self.ctx, self.xn = _normed(ids, vectors)
        self.norm = np.linalg.norm(self.xn, axis=1)
        self.bars, self.k = np.frombuffer(bars, np.float64).copy(), k
        self.row, self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, top: float) -> None:
        some = np.flatnonzero(self.norm * top * (1 + ROUNDING) >= self.bars)
        if not len(some):
            return
        row, item, score = _top_k_rows(self.xn[some] @ vectors.reshape(len(ids), -1).T, ids, min(self.k, len(ids)))
        row = some[row]
        over = score >= self.bars[row]
        row, item, score = (np.concatenate(x) for x in ((self.row, row[over]), (self.item, item[over]), (self.score, score[over])))
        order = np.lexsort((item, -score, row))
        row, item, score = row[order], item[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kth = rank == self.k - 1
        self.bars[row[kth]] = np.maximum(self.bars[row[kth]], score[kth] - ROUNDING * self.norm[row[kth]] * top)
        kept = rank < self.k
        self.row, self.item, self.score = row[kept], item[kept], score[kept]

    def rows(self, name: str) -> pa.RecordBatch:
        return pa.record_batch([pa.array(self.ctx[self.row]), pa.array(self.item), pa.array(self.score)], names=[name, "item_id", "score"])


def inner_product_top_k(
    contexts: DataFrame,
    items: DataFrame,
    k: int,
    *,
    ctx_col: str = "vec_id",
    item_col: str = "vec_id",
    vec_col: str = "embedding",
    max_items: int | None = None,
    ctx_block: int = 2048,
    item_block: int = 4096,
) -> DataFrame:
    """Top-k items per context by ``rms_norm(context) . item``.

    Any number of items; with ``max_items`` given, more rows are refused. Items lie in blocks
    of falling norm. The first of them give every context a bar under its k-th score; a block
    meets a context block only if its largest norm can reach one of its bars, and inside
    such a tile only the contexts whose own bar can be reached are multiplied. The bars are
    bounds, so the result is exact. A context block meets the item blocks of a partition in one task,
    where the best k so far are kept and raise the bars; the partitions' best are
    merged per context. No pair rows are made, no vectors pass through the driver, and a block is
    shuffled once, when it is made. Rows
    without an id, without a vector or with a null or non-finite component are neither contexts
    nor items.
    """
    n_items = items.count()
    few = options.Rule(lambda n: max_items is None or n <= max_items, f"a vocabulary of up to {max_items} rows")
    options.check(k=(k, options.COUNT), items=(n_items, few))
    blocks = stored(norm_blocks(_usable(items, item_col, vec_col), n_items, item_block), "item-blocks")
    left = _context_blocks(_usable(contexts, ctx_col, vec_col), contexts.count(), ctx_block)
    left = stored(with_bars(left, head_block(blocks, item_block), k), "context-blocks")
    if left.isEmpty():
        return left.select(F.lit(0).cast("long").alias(ctx_col), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
                if r["cb"] != now:
                    if done is not None:
                        yield done.rows(ctx_col)
                    now, done = r["cb"], _Best(r["ci"], r["cv"], r["bars"], k)
                done.meet(np.frombuffer(r["ii"], np.int64), np.frombuffer(r["iv"], np.float64), r["top"])
        if done is not None:
            yield done.rows(ctx_col)

    small_batches(items.sparkSession)  # a tile has megabytes
    tiles = needed_tiles(left, blocks).select("cb", "ci", "cv", "bars", "ii", "iv", "top")
    best = tiles.mapInArrow(score, f"`{ctx_col}` long, item_id long, score double")
    w = Window.partitionBy(ctx_col).orderBy(F.desc("score"), F.asc("item_id"))
    return best.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select(ctx_col, "rank", "item_id", "score")


# --------------------------------------------------------------------------- I1–I8


def check_penalty(penalty: float) -> None:
    options.check(penalty=(penalty, options.at_least(1.0)))


def with_rest(contexts: DataFrame, explicit: DataFrame, rest_logit: Column, vocab: int) -> DataFrame:
    """Candidates over the whole vocabulary 0..vocab-1 without a row per piece.

    ``explicit`` has ``(ctx_id, token_id, logit)`` for the pieces with a logit of their own,
    ``contexts`` one row per context with what ``rest_logit`` needs. All other pieces of a
    context share one logit: they become one row, ``token_id`` null, ``n`` pieces, and the
    sorted ids that are *not* among them in ``known``. An explicit row has ``n`` = 1.
    """
    known = explicit.groupBy("ctx_id").agg(F.sort_array(F.collect_set("token_id")).alias("known"))
    known_or_none = F.coalesce("known", F.array().cast("array<int>"))
    rest = contexts.join(known, "ctx_id", "left").select(
        "ctx_id", F.lit(None).cast("int").alias("token_id"), rest_logit.alias("logit"),
        (F.lit(vocab) - F.size(known_or_none)).cast("long").alias("n"), known_or_none.alias("known"),
    )
    own = explicit.select("ctx_id", F.col("token_id").cast("int").alias("token_id"), "logit", F.lit(1).cast("long").alias("n"),
                          F.lit(None).cast("array<int>").alias("known"))
    return own.unionByName(rest.where("n > 0"))


def absent_id(known: Column, rank: Column) -> Column:
    """The ``rank``-th id (from 0) that is not in the sorted array ``known``."""
    before = F.size(F.filter(F.transform(known, lambda e, i: e - i), lambda d: d <= rank))
    return (rank + before).cast("int")


def _whole(cands: DataFrame) -> DataFrame:
    """Candidates with the columns of :func:`with_rest`; plain rows stand for one piece each."""
    if "n" in cands.columns:
        return cands
    return cands.withColumns({"n": F.lit(1).cast("long"), "known": F.lit(None).cast("array<int>")})


def _plain(cands: DataFrame, like: DataFrame) -> DataFrame:
    return cands if "n" in like.columns else cands.drop("n", "known")


def repetition_penalty(cands: DataFrame, seen: DataFrame, penalty: float) -> DataFrame:
    """Seen tokens (I1): negative logits x p, others / p; each distinct token once. Seen
    pieces must be explicit rows; the rest row of a context is left as it is."""
    check_penalty(penalty)
    if penalty == 1.0:
        return cands
    s = seen.select("ctx_id", "token_id").distinct().withColumn("__seen", F.lit(True))
    j = cands.join(s, ["ctx_id", "token_id"], "left")
    pen = F.when(F.col("logit") < 0, F.col("logit") * F.lit(penalty)).otherwise(F.col("logit") / F.lit(penalty))
    return j.withColumn("logit", F.when(F.col("__seen"), pen).otherwise(F.col("logit"))).drop("__seen")


def greedy(cands: DataFrame) -> DataFrame:
    """Highest logit per context (I2); ties go to the lowest token id, of the rest as of the explicit pieces."""
    c = _whole(cands)
    first = F.when(F.col("token_id").isNull(), absent_id(F.col("known"), F.lit(0))).otherwise(F.col("token_id"))
    c = c.withColumn("__t", first)
    return c.groupBy("ctx_id").agg(F.max_by("__t", F.struct(F.col("logit"), -F.col("__t"))).alias("token_id"))


def temperature(cands: DataFrame, t: float) -> DataFrame:
    """logit / t (I3); t <= 0 means greedy and is handled by the caller."""
    return cands.withColumn("logit", F.col("logit") / F.lit(t))


temperature_scale = temperature  # the same step, for callers whose argument is named ``temperature``


def top_k(cands: DataFrame, k: int) -> DataFrame:
    """Keep tokens whose logit is not below the k-th largest (I4): ties stay, the rest stays or goes whole."""
    if k <= 0:
        return cands
    c = _whole(cands)
    # pieces with a strictly larger logit: a range frame that ends before this logit's peers
    by = Window.partitionBy("ctx_id").orderBy(F.desc("logit"))
    upto = F.sum("n").over(by)  # peers included
    peers = F.sum("n").over(Window.partitionBy("ctx_id", "logit"))
    kept = c.withColumn("__a", upto - peers).where(F.col("__a") < k).drop("__a")
    return _plain(kept, cands)


def softmax(cands: DataFrame, out: str = "prob") -> DataFrame:
    """exp(l - max) / sum per context (I6); the rest counts ``n`` times, its ``out`` is one piece's."""
    c = _whole(cands)
    w = Window.partitionBy("ctx_id")
    e = F.exp(F.col("logit") - F.max("logit").over(w))
    return _plain(c.withColumn("__e", e).withColumn(out, F.col("__e") / F.sum(F.col("__e") * F.col("n")).over(w)).drop("__e"), cands)


def top_p(cands: DataFrame, p: float) -> DataFrame:
    """Nucleus filter (I5): in (logit desc, explicit pieces first, token id) order keep a token
    while the probability mass *before* it is at most ``p``; the first always stays. Of the
    rest, the lowest ids stay: as many as fit."""
    if not 0.0 < p < 1.0:
        return cands
    sm = _whole(softmax(cands, "__p"))
    order = Window.partitionBy("ctx_id").orderBy(F.desc("logit"), F.asc_nulls_last("token_id"))
    before = F.coalesce(F.sum(F.col("__p") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    fit = F.floor((F.lit(p) - F.col("__b")) / F.col("__p")) + 1
    # an underflowed probability never fills the mass
    fit = F.when(F.col("__p") <= 0, F.col("n")).otherwise(F.least(F.col("n"), fit)).cast("long")
    kept = sm.withColumn("__b", before).where(F.col("__b") <= F.lit(p))
    kept = kept.withColumn("n", F.when(F.col("token_id").isNull(), fit).otherwise(F.col("n"))).drop("__p", "__b")
    return _plain(kept, cands)


def draw(probs: DataFrame, seed: int) -> DataFrame:
    """One token per context (I7): inverse CDF in token-id order with
    ``u = uniform01(seed, ctx_id)``; the first token whose inclusive running
    probability exceeds u (the last one if rounding leaves u above the total).

    The rest row stands for the lowest ``n`` ids outside ``known``; the running probability
    of an explicit token counts those of them that lie below it.
    """
    c = _whole(probs)
    rest = c.where(F.col("token_id").isNull()).select("ctx_id", F.col("prob").alias("__q"), F.col("n").alias("__m"), F.col("known").alias("__k"))
    own = c.where(F.col("token_id").isNotNull()).select("ctx_id", "token_id", "prob")
    every = c.select("ctx_id").distinct().join(rest, "ctx_id", "left").select(
        "ctx_id", F.coalesce("__q", F.lit(0.0)).alias("q"), F.coalesce("__m", F.lit(0)).cast("long").alias("m"),
        F.coalesce("__k", F.array().cast("array<int>")).alias("known"),
    )
    # rest pieces below a token: its id less the known ids below it, at most m
    joined = own.join(every, "ctx_id")
    below = F.least(F.col("m"), F.col("token_id") - F.size(F.filter("known", lambda e: e < F.col("token_id"))))
    w = Window.partitionBy("ctx_id").orderBy("token_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = joined.withColumn("__r", below).withColumn("__c", F.sum("prob").over(w) + F.col("q") * F.col("__r"))
    u = T.uniform01(seed, "ctx_id")
    over = F.col("__c") > u
    # the last explicit token not above u, and the first one above it
    agg = run.groupBy("ctx_id").agg(
        F.min(F.when(over, F.struct("token_id", (F.col("__c") - F.col("prob")).alias("c"), F.col("__r").alias("r")))).alias("hit"),
        F.max(F.when(~over, F.struct("token_id", F.col("__c").alias("c"), F.col("__r").alias("r")))).alias("low"),
        F.max("token_id").alias("last"),
    )
    j = every.join(agg, "ctx_id", "left").withColumn("u", u)
    c0, r0 = F.coalesce("low.c", F.lit(0.0)), F.coalesce("low.r", F.lit(0)).cast("long")
    step = F.when(F.col("q") > 0, F.floor((F.col("u") - c0) / F.col("q"))).otherwise(0)
    at = (r0 + F.greatest(step, F.lit(0))).cast("long")  # rest piece that u falls on
    in_rest = F.when(F.col("hit").isNotNull(), at < F.col("hit.r")).otherwise(at < F.col("m"))
    last = F.when(F.col("m") > 0, F.greatest(F.coalesce("last", F.lit(-1)), absent_id(F.col("known"), F.col("m") - 1))).otherwise(F.col("last"))
    pick = F.when(in_rest, absent_id(F.col("known"), at)).otherwise(F.coalesce(F.col("hit.token_id"), last))
    return j.select("ctx_id", pick.cast("int").alias("token_id"))


def propagate_eos(ids: Column, eos: int = T.EOS_ID) -> Column:
    """After the first EOS every token is EOS (I8)."""
    first = F.array_position(ids, F.lit(eos))
    n = F.size(ids)
    tail = F.array_repeat(F.lit(eos), (n - first).cast("int"))
    return F.when(first > 0, F.concat(F.slice(ids, 1, first.cast("int")), tail)).otherwise(ids)


def finished_length(ids: Column, eos: int = T.EOS_ID) -> Column:
    """Tokens up to and including the first EOS; the full length if none."""
    first = F.array_position(ids, F.lit(eos))
    return F.when(first > 0, first).otherwise(F.size(ids)).cast("int")


def decode_step(
    cands: DataFrame,
    seen: DataFrame | None = None,
    *,
    temperature: float = 0.6,
    k: int = 50,
    p: float = 0.95,
    penalty: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """One decoding step for many contexts, filters in the fixed order:
    penalty (I1), then the greedy pick when ``temperature <= 0`` (I2), else
    temperature (I3) -> top-k (I4) -> top-p (I5) -> softmax (I6) -> draw (I7).
    Returns ``(ctx_id, token_id)``."""
    check_penalty(penalty)
    c = repetition_penalty(cands, seen, penalty) if (seen is not None and penalty > 1.0) else cands
    if temperature <= 0:
        return greedy(c)
    probs = softmax(top_p(top_k(temperature_scale(c, temperature), k), p))
    return draw(probs, seed)

