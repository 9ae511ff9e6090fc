"""Helpers shared by the training-data operators: table reads, folds, record keys, two-phase running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import shared_path

# White space of the word contracts: \x20 \x09-\x0D
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# bytes.translate table that lower-cases A-Z and leaves every other byte alone
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

ROWS_PER_BUCKET = 500_000
MIN_BUCKETS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(col: Column) -> Column:
    """UTF-8 bytes of a text, null as empty: Python tasks then skip the decode."""
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


def running_sum(
    df: DataFrame, group: list[str], bucket: str, order: list, weight: str, out: str
) -> DataFrame:
    """Exclusive running sum of ``weight`` per group in the order (bucket, order), without one task per group.

    ``bucket`` must be a column that is monotone in the wanted order and cuts every
    group into many parts of like size (a hash prefix). Bucket sums give each bucket
    its base; a window per (group, bucket) does the rest. ``df`` is read twice, so it
    should be a written table. ``order`` must be total up to interchangeable rows.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(weight).alias("__s"))
    base = sums.withColumn(
        "__base", F.sum("__s").over(Window.partitionBy(*group).orderBy(bucket)) - F.col("__s")
    ).drop("__s")
    keys = [*group, bucket]
    left = df.alias("l")
    cond = None
    for k in keys:  # null-safe: a null group is a group like any other
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        cond = c if cond is None else cond & c
    joined = left.join(base.alias("r"), cond).select("l.*", F.col("r.__base"))
    win = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn(out, F.col("__base") + F.sum(weight).over(win) - F.col(weight)).drop("__base")


def unused(name: str, columns: list[str]) -> str:
    """``name``, or the first of name_1, name_2, ... that none of ``columns`` has (names ignore case)."""
    taken, k, found = {c.lower() for c in columns}, 0, name
    while found.lower() in taken:
        k += 1
        found = f"{name}_{k}"
    return found


def buckets_for(rows: int) -> int:
    """Bucket count that keeps buckets near ROWS_PER_BUCKET rows at any size."""
    return max(MIN_BUCKETS, -(-rows // ROWS_PER_BUCKET))


def expand(df: DataFrame, copies: str, index: str, chunk: int = 4096) -> DataFrame:
    """One row per copy with its ``index`` (0..copies-1); chunks keep the arrays short."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / chunk).cast("long"))
    both = df.where(F.col(copies) > 0).withColumn("__c", F.explode(parts))
    first = F.col("__c") * chunk
    last = F.least(first + (chunk - 1), F.col(copies) - 1)
    return both.withColumn(index, F.explode(F.sequence(first, last))).drop("__c")
