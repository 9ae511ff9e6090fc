"""Operator 7, SimHash near-duplicates by Golay-code fuzzy hashing.

A text's 64-bit fingerprint takes the majority of each bit over the XXH64 hashes of its
word shingles. Fingerprints that differ in at most three bits are linked.

Candidates come from the perfect binary Golay code (23, 12, 7): every 23-bit word has one
codeword within distance 3. The fingerprint is cut into segments of 23, 23 and 18 bits
(the last one zero-padded). Three differing bits over three segments leave two segments
with at most one each. If segments x, y differ in at most one bit, the codeword of x is
among the codewords of y and of y with one bit flipped (six at most). So for every pair
of segments (s, t) a fingerprint is filed twice:

    role A under (codeword of s, each near codeword of t)
    role B under (each near codeword of s, codeword of t)

and any linked x, y meet as A and B under one key. Pairs that meet are verified on all
64 bits; a task emits a spanning forest of the verified links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER_ASCII, materialise, text_bytes
from quire.llm.components import connected_components, local_roots

SEED = 42
MAX_BITS = 3
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
HOT_KEY = 50_000  # filings of one key beyond which its A side is dealt over several tasks
PAIRS_AT_ONCE = 1 << 20
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text (bytes); no words: 0."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    first = ends - lengths + 1
    k = min(shingle, len(words))
    lo, hi = first[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(lo), _CHUNK):
        part = list(zip(lo[at : at + _CHUNK], hi[at : at + _CHUNK], strict=True))
        h = np.fromiter((digest(joined[s:e], seed) for s, e in part), "<u8", len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(lo), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id, text_md5, fp (the fingerprint as a signed long) per row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(f.view(np.int64))], names=["doc_id", "text_md5", "fp"])

    raw = text_bytes(docs["text"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.md5(raw).alias("text_md5"), raw.alias("t")).mapInArrow(
        run, "doc_id long, text_md5 string, fp long"
    )


# --- the code -------------------------------------------------------------------------


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial: 11 bits, 0 for codewords."""
    r = words.astype(np.int64)
    for i in range(22, 10, -1):
        r = r ^ ((r >> i & 1) * (GENERATOR << (i - 11)))
    return r


def error_patterns() -> np.ndarray:
    """The one pattern of at most three bits for each of the 2048 syndromes."""
    bits = [1 << i for i in range(23)]
    patterns = [0, *bits]
    patterns += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    patterns += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    p = np.array(patterns, np.int64)
    table = np.empty(2048, np.int64)
    table[syndrome(p)] = p
    return table


class Golay:
    def __init__(self) -> None:
        self.error = error_patterns()
        self.flips = syndrome(1 << np.arange(23))

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index (the 12 message bits) of the codeword within distance 3."""
        return (words ^ self.error[syndrome(words)]) >> 11

    def near(self, words: np.ndarray, bits: int) -> np.ndarray:
        """words x (bits + 1): indices for the word and for it with each of ``bits`` bits flipped; repeats are -1."""
        s = syndrome(words)
        out = np.empty((len(words), bits + 1), np.int64)
        out[:, 0] = (words ^ self.error[s]) >> 11
        for i in range(bits):
            out[:, i + 1] = (words ^ (1 << i) ^ self.error[s ^ self.flips[i]]) >> 11
        out.sort(axis=1)
        out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
        return out


def filings(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, role, fp) rows under which fingerprints (unsigned) are filed; role 0 is A, 1 is B."""
    seg = [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [golay.nearest(s) for s in seg]
    near = [golay.near(s, n) for s, (_, n) in zip(seg, SEGMENTS, strict=True)]
    keys, roles, rows = [], [], []
    for p, (s, t) in enumerate(PAIRS):
        i, j = np.nonzero(near[t] >= 0)
        keys.append(p << 24 | own[s][i] << 12 | near[t][i, j])
        roles.append(np.zeros(len(i), np.int8))
        rows.append(i)
        i, j = np.nonzero(near[s] >= 0)
        keys.append(p << 24 | near[s][i, j] << 12 | own[t][i])
        roles.append(np.ones(len(i), np.int8))
        rows.append(i)
    at = np.concatenate(rows)
    return np.concatenate(keys), np.concatenate(roles), fp[at]


# --- verification ----------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that span the components of the links a - b (unsigned fingerprints)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_roots(len(nodes), inv[: len(a)], inv[len(a) :])
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def large_group(a: np.ndarray, b: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one key with very many fingerprints, without comparing pairs that are linked already.

    Fingerprints one bit apart are found by lookup; then only rows of different components
    are compared, in blocks, so a dense group costs little more than its stragglers.
    """
    nodes = np.unique(np.concatenate([a, b]))
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if max_bits >= 1:
        for i in range(64):
            other = nodes ^ np.uint64(1 << i)
            at = np.minimum(np.searchsorted(nodes, other), len(nodes) - 1)
            hit = np.flatnonzero((nodes[at] == other) & (at > np.arange(len(nodes))))
            u.append(hit)
            v.append(at[hit])
    root = local_roots(len(nodes), np.concatenate(u), np.concatenate(v))
    in_b = np.isin(nodes, b)
    order = np.argsort(root, kind="stable")
    cand = order[in_b[order]]
    rows = order[np.isin(nodes[order], a)]
    step = max(1, PAIRS_AT_ONCE // max(1, len(cand)))
    sizes = np.bincount(root, minlength=len(nodes))
    giant = int(sizes.argmax())
    for at in range(0, len(rows), step):
        r = rows[at : at + step]
        if (root[r] == giant).all():  # the giant against itself is linked; only the others matter
            c = cand[root[cand] != giant]
        else:
            c = cand
        for lo in range(0, len(c), PAIRS_AT_ONCE):
            cc = c[lo : lo + PAIRS_AT_ONCE]
            i, j = np.nonzero((root[r][:, None] != root[cc][None, :]) & (np.bitwise_count(nodes[r][:, None] ^ nodes[cc][None, :]) <= max_bits))
            if len(i):
                yield nodes[r[i]], nodes[cc[j]]
                root = local_roots(len(nodes), np.concatenate([np.arange(len(nodes)), r[i]]), np.concatenate([root, cc[j]]))
                giant = int(np.bincount(root, minlength=len(nodes)).argmax())
    child = np.flatnonzero(root != np.arange(len(nodes)))
    yield nodes[child], nodes[root[child]]


def links_of_sorted(key: np.ndarray, role: np.ndarray, fp: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links of whole keys; rows are sorted by key, then role."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(start[1:], len(key))
    n_b = np.add.reduceat(role.astype(np.int64), start)
    n_a = end - start - n_b
    alone = (end - start == 2) & (fp[start] == fp[end - 1])  # a fingerprint meets itself under its own codewords
    todo = np.flatnonzero((n_a > 0) & (n_b > 0) & ~alone)
    work = n_a * n_b
    for g in todo[work[todo] > 4 * PAIRS_AT_ONCE]:
        s = slice(start[g], end[g])
        for a, b in large_group(fp[s][: n_a[g]], fp[s][n_a[g] :], max_bits):
            if len(a):
                yield forest(a, b)
    small = todo[work[todo] <= 4 * PAIRS_AT_ONCE]
    if not len(small):
        return
    batch = np.cumsum(work[small]) // PAIRS_AT_ONCE
    for g in np.split(small, np.flatnonzero(np.diff(batch)) + 1):
        total = work[g].sum()
        base = np.repeat(np.cumsum(work[g]) - work[g], work[g])
        within = np.arange(total) - base
        width = np.repeat(n_b[g], work[g])
        a = fp[np.repeat(start[g], work[g]) + within // width]
        b = fp[np.repeat(start[g] + n_a[g], work[g]) + within % width]
        hit = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
        if hit.any():
            yield forest(a[hit], b[hit])


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: links that span the components of distinct fingerprints ``fp`` at ``max_bits`` or fewer differing bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"two of three segments hold at most one error each up to {MAX_BITS} bits, not {max_bits}")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in batches:
            k, r, f = filings(b.column(0).to_numpy().view(np.uint64), golay)
            yield pa.record_batch([pa.array(k), pa.array(r), pa.array(f.view(np.int64))], names=["key", "role", "fp"])

    filed = fps.select("fp").mapInArrow(file, "key long, role byte, fp long")
    counts = filed.groupBy("key").count().where(F.col("count") > HOT_KEY)
    parts = F.coalesce(F.ceil(F.col("count") / HOT_KEY), F.lit(1)).cast("int")
    dealt = filed.join(counts, "key", "left").withColumn("n", parts)
    every = F.sequence(F.lit(0), F.col("n") - 1)
    salt = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))).otherwise(every)
    salted = dealt.select("key", "role", "fp", F.explode(salt).alias("part")).select((F.col("key") * 65536 + F.col("part")).alias("key"), "role", "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for x, y in links_of_sorted(*rows, max_bits):
                yield pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64))
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on in the next batch
            if cut:
                whole = [np.concatenate([h[i] for h in held] + [rows[i][:cut]]) for i in range(3)]
                yield from out(tuple(whole))
                held = []
            held.append(tuple(x[cut:] for x in rows))
            if len(held) > 1 and held[0][0][0] != rows[0][-1]:
                yield from out(tuple(np.concatenate([h[i] for h in held[:-1]]) for i in range(3)))
                held = held[-1:]
        if held:
            yield from out(tuple(np.concatenate([h[i] for h in held]) for i in range(3)))

    return salted.repartition("key").sortWithinPartitions("key", "role", "fp").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """doc_id, text_md5, fp, root, component_id: one row per row of ``docs``.

    ``root`` names the class (a fingerprint), ``component_id`` is the smallest doc_id in it.
    Copies collapse to one fingerprint before any candidate is made and are joined back at
    the end. Null, empty and blank texts have fingerprint 0 and are linked like any other;
    texts shorter than a shingle are one shingle. Null doc_ids belong to classes but never
    name them (a class of null ids only has a null id). Empty table: no rows. Columns
    besides doc_id and text are not read.
    """
    rows = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    per_fp = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    links = link_fingerprints(per_fp.select("fp"), max_bits)
    roots = connected_components(links).withColumnRenamed("node", "fp")
    placed = per_fp.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    low = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.select("fp", "root").join(low, "root")
    return rows.join(named, "fp").select("doc_id", "text_md5", "fp", "root", "component_id")


def one_per_class(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` of which one per class stays: smallest doc_id (nulls last), then smallest text hash."""
    groups = near_duplicates(docs, shingle, max_bits)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_md5")).alias("k"))
    keep = first.select(F.col("k.doc_id").alias("__id"), F.col("k.text_md5").alias("__m")).distinct()
    keyed = docs.withColumn("__m", F.md5(text_bytes(F.col("text")))).alias("d")
    cond = (F.col("d.__m") == F.col("k.__m")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.__id"))
    # rows alike in id and text: one stays
    kept = keyed.join(keep.alias("k"), cond, "left_semi").dropDuplicates(["doc_id", "__m"])
    return kept.select(*docs.columns)
