"""Operator 10, nearest neighbours by a block matrix join.

Queries and candidates are cut into blocks; a tile is one query block against one
candidate block. Inside a tile int8 codes give every inner product up to a proven error:

    x = sx (qx + ex), |ex| <= 1/2 per component, likewise y, hence
    |x.y - sx sy qx.qy| <= sx sy (|qx|_1 / 2 + |qy|_1 / 2 + d / 4)

A pair survives if its upper bound reaches the k-th best lower bound of its query in the
tile, counted over ids, not rows; survivors are recomputed in double precision from the
original vectors, and the tiles' heaps of k are merged per query. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
_SLACK = 1e-9  # for rounding in the float64 bounds, relative to their size


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _blocks(rows: DataFrame, block: int, side: str) -> DataFrame:
    """(dim, <side>, ids, vectors): one row per block, vectors as float64 bytes.

    A block is a hash bucket of ids; the bucket count follows the row count, so blocks hold
    about ``block`` rows at any size.
    """
    n = rows.groupBy("dim").count().select("dim", F.greatest(F.lit(1), F.ceil(F.col("count") / block)).cast("int").alias("n"))
    dealt = rows.join(n, "dim").withColumn(side, F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"))

    def pack(key: tuple, batch: pa.Table) -> pa.Table:
        ids = batch.column("vec_id").to_numpy()
        flat = batch.column("v").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        return pa.table({
            "dim": pa.array([key[0].as_py()], pa.int32()), side: pa.array([key[1].as_py()], pa.int32()),
            "n": batch.column("n").slice(0, 1), "ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()),
            "vectors": pa.array([np.ascontiguousarray(flat[order], np.float64).tobytes()], pa.binary()),
        })

    packed = dealt.select("dim", side, "n", "vec_id", "v").groupBy("dim", side)
    return packed.applyInArrow(pack, f"dim int, {side} int, n int, ids binary, vectors binary")


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale per row, and half the 1-norm of the codes per row. Rows too small to scale have scale NaN."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale < np.finfo(np.float64).tiny] = np.nan
    q = np.nan_to_num(np.rint(x / scale[:, None])).astype(np.int8)
    return q, scale, np.abs(q.astype(np.float64)).sum(axis=1) / 2


def dot_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, components added one after another in double precision."""
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s += a[:, j] * b[:, j]
    return s


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query row's k best ids in the tile, own id left out.

    ``c_ids`` is sorted; rows of one id stand together and count as their best. Where a bound
    has no finite value (products beyond the range of doubles) the pair is computed itself.
    A score that is no number ranks first, as in SQL.
    """
    d = q.shape[1]
    qc, qs, qh = codes(q)
    cc, cs, ch = codes(c)
    # products of int8 codes are whole numbers below 2^53: the matrix product is exact
    kind = np.float32 if d * 127 * 127 < 2**24 else np.float64
    approx = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        unit = qs[:, None] * cs[None, :]
        err = unit * (qh[:, None] + ch[None, :] + d / 4) * (1 + 1e-6)
        approx *= unit
        err += _SLACK * (np.abs(approx) + err)
        lower, upper = approx - err, approx + err
        # a sum of d products in order must not leave the range either
        wild = ~np.isfinite(lower) | ~np.isfinite(upper) | ~np.isfinite(unit * 127.0 * 127.0 * d)
    lower[wild], upper[wild] = -np.inf, np.inf
    own = q_ids[:, None] == c_ids[None, :]
    lower[own], upper[own] = -np.inf, -np.inf
    starts = np.flatnonzero(np.concatenate([[True], c_ids[1:] != c_ids[:-1]]))
    by_id = np.maximum.reduceat(lower, starts, axis=1) if len(starts) < len(c_ids) else lower
    m = by_id.shape[1]
    bar = np.partition(by_id, m - k, axis=1)[:, m - k] if m > k else np.full(len(q), -np.inf)
    qi, ci = np.nonzero((upper >= bar[:, None]) & ~own)
    with np.errstate(over="ignore", invalid="ignore"):
        score = dot_rows(q[qi], c[ci])
    none = np.isnan(score)
    falling = -np.where(none, np.inf, score)
    # the best row of every (query row, id), then the k best ids
    order = np.lexsort((falling, ~none, c_ids[ci], qi))
    qi, ci, score, none, falling = (x[order] for x in (qi, ci, score, none, falling))
    best = np.ones(len(qi), bool)
    best[1:] = (qi[1:] != qi[:-1]) | (c_ids[ci[1:]] != c_ids[ci[:-1]])
    qi, ci, score, none, falling = (x[best] for x in (qi, ci, score, none, falling))
    order = np.lexsort((c_ids[ci], falling, ~none, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    first = np.searchsorted(qi, np.arange(len(q)))
    best = np.arange(len(qi)) - first[qi] < k
    return q_ids[qi[best]], c_ids[ci[best]], score[best]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every query by inner product, ties to the smaller vec_id.

    ``vectors`` has vec_id and embedding; ``queries`` picks the query rows. Unusable vectors
    (null, empty, zero, null or non-finite components) and null ids take no part; vectors of
    different lengths are not compared. A vec_id that repeats stands for its rows together:
    rows alike count once, rows that differ are all candidates and queries (a query's own id
    is never its neighbour), and a pair of ids keeps its best score. Fewer candidates than k:
    all of them. Empty table: no rows. Other columns are not read.

    The stated query set meets all rows in blocks: a tile gets two blocks, never more.
    """
    v = F.col("embedding")
    rows = vectors.where(usable(v) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size(v).alias("dim"), v.cast("array<double>").alias("v"), queries.alias("is_query")
    )
    rows = rows.dropDuplicates(["vec_id", "v"])
    q = materialise(_blocks(rows.where("is_query"), query_block, "qb"), "ann-queries")
    c = materialise(_blocks(rows, candidate_block, "cb"), "ann-candidates")
    counts_q = q.groupBy("dim").agg(F.max("n").alias("nq"))
    counts_c = c.groupBy("dim").agg(F.max("n").alias("nc"))
    qt = q.join(counts_c, "dim").select("dim", "qb", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("cb"), F.col("ids").alias("qi"), F.col("vectors").alias("qv"))
    ct = c.join(counts_q, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), "cb", F.col("ids").alias("ci"), F.col("vectors").alias("cv"))
    tiles = qt.join(ct, ["dim", "qb", "cb"]).select("dim", "qi", "qv", "ci", "cv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                d = b.column(0)[r].as_py()
                qi, ci = (np.frombuffer(b.column(j)[r].as_py(), np.int64) for j in (1, 3))
                qv, cv = (np.frombuffer(b.column(j)[r].as_py(), np.float64).reshape(-1, d) for j in (2, 4))
                i, j, s = tile(qi, qv, ci, cv, k)
                yield pa.record_batch([pa.array(i), pa.array(j), pa.array(s)], names=["query_id", "vec_id", "score"])

    partial = tiles.mapInArrow(run, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for b in batches:
            for i, j, s in zip(*(x.to_pylist() for x in b.columns), strict=True):
                h, new = heaps.setdefault(i, []), (s != s, 0.0 if s != s else s, -j)
                if len(h) < k:
                    heapq.heappush(h, new)
                elif new > h[0]:
                    heapq.heapreplace(h, new)
        out = [(i, r, -j, float("nan") if no else s) for i, h in heaps.items() for r, (no, s, j) in enumerate(sorted(h, reverse=True), 1)]
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"])

    # a vec_id with several vectors: one entry per pair of ids before the heaps
    single = partial.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return single.repartition(F.col("query_id")).mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
