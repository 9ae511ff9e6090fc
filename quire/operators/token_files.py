"""Token arrays in files of the shared folder, read by address where blocks are cut.

A mix repeats documents and a shuffle lays them anew. With the arrays in files only addresses
``(file, at, n)`` pass through the exchanges that order the stream; the task that cuts a stretch
of blocks reads the tokens of that stretch. So no token is shuffled, however often its document
is repeated. A document lies in compressed frames of FRAME ids: of a long one only the frames
that a stretch needs are read. A task writes a file of its own; one that failed leaves a file
that no row names.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import options
from quire.functions import text as T
from quire.operators import offsets as O
from quire.operators.pack import last_block_of, narrow_offsets
from quire.session import plain_path, shared_path, small_batches, stored

FRAME = 32_768  # ids that are compressed together
STRETCH_TOKENS = 1 << 16  # of neighbouring blocks that one group cuts
TOKENS_PER_TASK = 2_000_000
MAX_OPEN = 64  # files that a task holds open
CODEC = "zstd"


def new_folder(docs: DataFrame) -> str | None:
    """A folder for :func:`write_ids`, or None where Python cannot open the shared folder by its path."""
    return plain_path(shared_path(docs.sparkSession, "ids"))


def write_ids(docs: DataFrame, folder: str) -> DataFrame:
    """``docs`` with ``n, file, at`` (number of ids and their address) in place of the array ``ids``; written once."""
    keep = [c for c in docs.columns if c != "ids"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        task, codec = TaskContext.get().taskAttemptId(), pa.Codec(CODEC, 1)
        with open(f"{folder}/{task}", "xb") as out:
            for b in batches:
                lists = b.column(len(keep))
                n = lists.value_lengths().fill_null(0).to_numpy()
                ends, flat = np.concatenate([[0], np.cumsum(n)]), lists.flatten().to_numpy()
                at = np.empty(len(n), np.int64)
                for i in range(len(n)):
                    ids, at[i] = flat[ends[i] : ends[i + 1]], out.tell()
                    ids = ids.astype(np.uint16) if len(ids) and ids.min() >= 0 and ids.max() < 1 << 16 else ids.astype(np.int32)
                    frames = [codec.compress(np.ascontiguousarray(ids[j : j + FRAME]), asbytes=True) for j in range(0, len(ids), FRAME)]
                    out.write(np.array([ids.itemsize, *map(len, frames)], np.int32).tobytes() + b"".join(frames))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[: len(keep)], pa.array(n.astype(np.int32)), pa.array(np.full(len(n), task, np.int64)), pa.array(at)],
                    names=[*keep, "n", "file", "at"],
                )

    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return stored(docs.select(*keep, "ids").mapInArrow(put, f"{schema}, n int, file long, at long"), "addresses")


class _Files:
    """The files of a folder, the last used held open."""

    def __init__(self, folder: str):
        self.folder, self.open, self.codec = folder, OrderedDict(), pa.Codec(CODEC)

    def ids(self, file: int, at: int, n: int, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi`` of the ``n`` that begin at ``at``."""
        lo, hi = max(lo, 0), min(hi, n)
        if hi <= lo:
            return np.zeros(0, np.int32)
        if file in self.open:
            self.open.move_to_end(file)
        else:
            if len(self.open) >= MAX_OPEN:
                self.open.popitem(last=False)[1].close()
            self.open[file] = open(f"{self.folder}/{file}", "rb")
        f = self.open[file]
        f.seek(at)
        head = np.frombuffer(f.read(4 * (1 - -n // FRAME)), np.int32)
        first, last = lo // FRAME, (hi - 1) // FRAME
        f.seek(int(head[1 : 1 + first].sum()), os.SEEK_CUR)
        kind = np.uint16 if head[0] == 2 else np.int32
        parts = [
            np.frombuffer(self.codec.decompress(f.read(int(head[1 + j])), min(FRAME, n - j * FRAME) * int(head[0])), kind)
            for j in range(first, last + 1)
        ]
        whole = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return whole[lo - first * FRAME : hi - first * FRAME]

    def tokens(self, r: dict, lo: int, hi: int, eos: int | None) -> np.ndarray:
        """Tokens ``lo`` to ``hi`` of a row's document, of which it has ``L`` in the stream; ``eos`` ends it."""
        hi = min(hi, r["L"])
        ids = self.ids(r["file"], r["at"], r["n"], lo, hi).astype(np.int32)
        return np.append(ids, np.int32(eos)) if eos is not None and lo <= r["n"] < hi else ids

    def close(self) -> None:
        for f in self.open.values():
            f.close()


def _laid_end_to_end(rows: list[dict], eos: int | None) -> bool:
    """Whether every document begins where the one before it ends, and has its whole length in the stream."""
    extra = eos is not None
    return all(r["L"] == r["n"] + extra for r in rows) and all(a["start"] + a["L"] == b["start"] for a, b in zip(rows, rows[1:]))


def _windows(rows: list[dict], files: _Files, S: int, lo: int, hi: int, eos: int | None) -> tuple[np.ndarray, np.ndarray, list]:
    """For blocks ``lo`` to ``hi``: their stream tokens one after the other, where those of each begin and end
    (at most S + 1, neighbours share one), and their first documents."""
    if _laid_end_to_end(rows, eos):
        p0, p1 = lo * S, hi * S + S
        flat = np.concatenate([files.tokens(r, max(p0 - r["start"], 0), p1 - r["start"] + 1, eos) for r in rows])
        begin = np.arange(hi - lo + 1) * S
        first = np.searchsorted(np.array([r["start"] + r["L"] for r in rows]), p0 + begin, "right")
        return flat, np.stack([begin, np.minimum(begin + S + 1, len(flat))]), [rows[i]["doc_id"] for i in first]
    # documents that share a key lie over each other: the pieces of a block are put in order one by one
    flat, docs = [], []
    for b0 in range(lo * S, hi * S + 1, S):
        pieces = []
        for r in rows:
            if r["start"] <= b0 + S and r["start"] + r["L"] > b0:
                begin = max(r["start"], b0)
                pieces.append((begin, r["doc_id"], files.tokens(r, begin - r["start"], b0 + S - r["start"] + 1, eos).tolist()))
        pieces.sort()
        flat.append(np.array([t for p in pieces for t in p[2]], np.int32))
        docs.append(pieces[0][1] if pieces else None)
    ends = np.cumsum([len(w) for w in flat])
    return np.concatenate(flat), np.stack([ends - [len(w) for w in flat], ends]), docs


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values)))


def _parts(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of stretches of ``flat``, one after the other, and their sizes."""
    sizes = np.maximum(end - begin, 0)
    if len(sizes) and (begin[1:] == end[:-1]).all():
        return flat[begin[0] : end[-1]], sizes
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat[np.repeat(begin, sizes) + at], sizes


def pack_stored(
    docs: DataFrame,
    folder: str,
    seq_length: int,
    bucketing: O.Bucketing,
    *,
    add_eos: bool = True,
    drop_last: bool = True,
    ordered: bool = False,
) -> DataFrame:
    """The packed samples of :func:`quire.operators.pack.pack_blocks`, of documents
    ``(shard, pos, doc_id, n, file, at)`` whose ids lie in ``folder``; ``ordered``: see :func:`cut_stored`."""
    docs = stored(docs.select("shard", "pos", "doc_id", "n", "file", "at"), "documents")
    lengths = docs.select("shard", "pos", (F.col("n") + F.lit(int(add_eos))).alias("L"))
    rows = docs.join(narrow_offsets(lengths, bucketing), ["shard", "pos"])
    total = lengths.agg(F.sum("L")).first()[0] or 0
    return cut_stored(rows, folder, seq_length, total, add_eos=add_eos, drop_last=drop_last, ordered=ordered)


def cut_stored(
    d: DataFrame,
    folder: str,
    seq_length: int,
    total: int,
    *,
    add_eos: bool = True,
    drop_last: bool = True,
    ordered: bool = False,
    eos_id: int = T.EOS_ID,
    pad_id: int = T.PAD_ID,
    ignore_index: int = T.IGNORE_INDEX,
) -> DataFrame:
    """The packed samples of :func:`quire.operators.pack.cut_blocks`, of documents with stream offsets and an
    address (``shard, doc_id, L, start, T, n, file, at``) in ``folder``.

    ``total`` is the number of tokens in the stream. With ``ordered`` the partitions are ranges of (shard, block) in
    order, which only the addresses are sorted for.
    """
    options.check(seq_length=(seq_length, options.COUNT))
    S, K, eos = seq_length, max(1, STRETCH_TOKENS // seq_length), eos_id if add_eos else None
    spark = d.sparkSession
    nb, last = last_block_of(S, drop_last)
    d = d.withColumn("nb", nb).withColumn("last", last)
    lo = F.greatest(F.floor((F.col("start") - 1) / S), F.lit(0)).cast("long")
    hi = F.least(F.floor((F.col("start") + F.col("L") - 1) / S).cast("long"), F.col("last"))
    d = d.withColumn("lo", lo).withColumn("hi", hi).where(F.col("hi") >= F.col("lo"))
    stretch = F.explode(F.sequence(F.floor(F.col("lo") / K), F.floor(F.col("hi") / K)))
    cols = ["shard", "block_id", "doc_id", "start", "L", "T", "nb", "last", "n", "file", "at"]
    d = d.withColumn("block_id", stretch).withColumn("block_id", (F.col("block_id") * K).cast("long")).select(*cols)
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TOKENS_PER_TASK))
    dealt = d.repartitionByRange(tasks, "shard", "block_id") if ordered else d.repartition(tasks, "shard", "block_id")
    dealt = dealt.sortWithinPartitions("shard", "block_id", "start")

    def blocks_of(rows: list[dict], files: _Files, types: dict) -> pa.RecordBatch:
        r, lo = rows[0], rows[0]["block_id"]
        hi = min(lo + K - 1, r["last"])
        flat, (begin, end), docs = _windows(rows, files, S, lo, hi, eos)
        m, tail = hi - lo + 1, hi == r["nb"]
        full = m - tail
        ids, n_ids = _parts(flat, begin[:full], np.minimum(begin + S, end)[:full])
        told, n_told = _parts(flat, begin[:full] + 1, np.minimum(begin + S + 1, end)[:full])
        masks = np.ones(m * S, np.int8)
        if tail:
            size, w = r["T"] - hi * S, flat[begin[-1] : end[-1]]
            w = np.concatenate([w, np.full(max(0, S + 1 - len(w)), pad_id, np.int32)])
            last_told = w[1 : S + 1].copy()
            last_told[size - 1 :], masks[full * S + size :] = ignore_index, 0
            ids, told = np.concatenate([ids, w[:S]]), np.concatenate([told, last_told])
            n_ids, n_told = np.append(n_ids, S), np.append(n_told, S)
        return pa.RecordBatch.from_arrays(
            [pa.array([r["shard"]] * m, types["shard"]), pa.array(np.arange(lo, hi + 1)), _lists(ids, n_ids), _lists(told, n_told),
             _lists(masks, np.full(m, S)), pa.array(docs, types["doc_id"]), pa.array(np.arange(lo, hi + 1) == r["nb"])],
            names=["shard", "block_id", "input_ids", "labels", "attention_mask", "first_doc_id", "is_tail"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, rows, types = _Files(folder), [], {}
        try:
            for b in batches:
                types = {c: b.schema.field(c).type for c in ("shard", "doc_id")}
                for r in b.to_pylist():
                    if rows and (r["shard"], r["block_id"]) != (rows[0]["shard"], rows[0]["block_id"]):
                        yield blocks_of(rows, files, types)
                        rows = []
                    rows.append(r)
            if rows:
                yield blocks_of(rows, files, types)
        finally:
            files.close()

    kinds = {c: d.schema[c].dataType.simpleString() for c in ("shard", "doc_id")}
    return dealt.mapInArrow(
        cut, f"shard {kinds['shard']}, block_id long, input_ids array<int>, labels array<int>, attention_mask array<tinyint>, "
             f"first_doc_id {kinds['doc_id']}, is_tail boolean",
    )
