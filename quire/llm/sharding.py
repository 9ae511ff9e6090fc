"""Operator 1, sharding: rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a uniform hash u; the record goes to the shard with the
least -ln(u) / weight. A new shard only ever wins records for itself, so growing from
n to n+1 equal shards moves about 1 / (n + 1) of them and none between old shards.

Native DataFrame expressions only. Hashes are xxhash64 of (seed, shard, key, key is null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import buckets_for, expand, materialise, running_sum

SEED = 20240611


def _cost(key: Column, shard: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from 53 hash bits; monotone in the shard's claim on the key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), shard.cast("int"), key, key.isNull()), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**53))) / weight


def rendezvous(key: Column, weights: list[float], seed: int = SEED) -> Column:
    """struct(cost, shard) of the winning shard. Equal costs go to the smaller shard.

    ``key`` is any column (cast to string); a null key is a key of its own.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above zero")
    key = key.cast("string")
    w = F.array(*[F.lit(float(x)) for x in weights])
    shards = F.sequence(F.lit(0), F.lit(len(weights) - 1))
    return F.array_min(
        F.transform(shards, lambda j: F.struct(_cost(key, j, F.get(w, j), seed).alias("cost"), j.cast("int").alias("shard")))
    )


def grown_shard(best: Column, key: Column, n: int, weight: float = 1.0, seed: int = SEED) -> Column:
    """Shard after shard ``n`` joins the ``n`` old ones: only the newcomer's cost is new."""
    return F.when(_cost(key.cast("string"), F.lit(n), F.lit(float(weight)), seed) < best["cost"], F.lit(n)).otherwise(best["shard"])


def shard_documents(docs: DataFrame, n_shards: int = 16, weights: list[float] | None = None, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the shard count (with weights) decide, nothing else.
    Slots number a shard's records from 0 without gaps, in the order (hash bucket, doc_id,
    text hash). Records that agree in id and text are interchangeable: they are counted as
    one row with a multiplicity before any shuffle by key and are dealt out again at the
    end, so an id or text that holds a third of all rows stays one row.

    Null text: size 1, crc32 of no bytes (0). Null doc_id: a key of its own, kept as null.
    Repeated doc_ids share a shard and get slots of their own. Empty table: no rows.
    Columns besides doc_id and text are not read, so their names cannot clash.
    """
    weights = weights or [1.0] * n_shards
    if len(weights) != n_shards:
        raise ValueError("one weight per shard is needed")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    records = narrow.groupBy("doc_id", "size", "text_crc32", "text_hash").agg(F.count("*").alias("copies"))
    key = F.col("doc_id")
    best = F.col("best")
    placed = records.withColumn("best", rendezvous(key, weights, seed)).select(
        "*", best["shard"].alias("shard"), grown_shard(best, key, n_shards, 1.0, seed).cast("int").alias("grown_shard")
    ).drop("best")
    placed = materialise(placed, "shards")
    n = buckets_for(placed.count())
    # the bucket sees the whole record key: records of one id with many texts spread too
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("text_hash", F.col("doc_id").cast("string"), F.lit(seed)), F.lit(n)))
    based = running_sum(placed, ["shard"], "bucket", ["doc_id", "text_hash", "text_crc32", "size"], "copies", "first_slot")
    rows = expand(based, "copies", "copy")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first_slot") + F.col("copy")).alias("slot"), "grown_shard",
    )
