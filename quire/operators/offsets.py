"""Two-phase global positions and running sums (no single-partition window).

A global order over N rows normally needs ``Window.orderBy`` without a
partition, which funnels every row into one task. Instead:

1. every row gets a coarse *bucket* that is monotone in the order key;
2. ``groupBy(group, bucket)`` sums the weights (a tiny table);
3. an exclusive running sum over that tiny table gives each bucket's base;
4. the base joins back, and a window partitioned by ``(group, bucket)``
   finishes the running sum inside each bucket.

Buckets come from a hash prefix (shuffled orders: uniform by construction)
or from approximate quantiles of an id (robust to uneven id ranges), so no
bucket holds a disproportionate share of rows even when one group does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TARGET_ROWS_PER_BUCKET = 1_000_000
MIN_BUCKETS = 16  # also for small inputs: the path that is tested is the path that runs at scale


@dataclass(frozen=True)
class Bucketing:
    """How rows are cut into ordered buckets: adds ``__b`` and bounds the bucket count."""

    max_buckets: int
    expr: Column | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.transform is not None:
            return self.transform(df)
        return df.withColumn("__b", self.expr)


def hash_prefix_bucketing(hex_col: Column | str, digits: int = 3) -> Bucketing:
    """Buckets from the first ``digits`` hex digits of an md5 order key (16^digits buckets)."""
    c = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return Bucketing(16**digits, expr=F.conv(F.substring(c, 1, digits), 16, 10).cast("long"))


def digits_for_rows(n_rows: int) -> int:
    """Hash-prefix width so that buckets stay near TARGET_ROWS_PER_BUCKET rows."""
    d = 1
    while 16**d * TARGET_ROWS_PER_BUCKET < n_rows:
        d += 1
    return d


def buckets_for(n_rows: int, cores: int = 1) -> int:
    """Buckets of at most TARGET_ROWS_PER_BUCKET rows, and enough to keep the cores busy."""
    return max(MIN_BUCKETS, cores, -(-n_rows // TARGET_ROWS_PER_BUCKET))


def position_bucketing(col: str, n_rows: int, spark: SparkSession) -> Bucketing:
    """Buckets over dense positions 0..n-1."""
    return dense_range_bucketing(col, 0, max(n_rows - 1, 0), buckets_for(n_rows, spark.sparkContext.defaultParallelism))


def dense_range_bucketing(col: Column | str, lo: int, hi: int, n_buckets: int) -> Bucketing:
    """Equal-width buckets over a dense integer key in [lo, hi] (e.g. generated draw indexes)."""
    c = F.col(col) if isinstance(col, str) else col
    width = max(1, -(-(hi - lo + 1) // max(1, n_buckets)))
    return Bucketing(max(1, -(-(hi - lo + 1) // width)), expr=F.floor((c - F.lit(lo)) / F.lit(width)).cast("long"))


def quantile_bucketing(df: DataFrame, col: str, n_rows: int | None = None) -> Bucketing:
    """Buckets from approximate quantiles of a numeric key: equal row counts, any id layout.

    One small job computes the split points; ``Bucketizer`` then finds each
    row's bucket by binary search, JVM-side.
    """
    from pyspark.ml.feature import Bucketizer

    if n_rows is None:
        n_rows = df.count()
    n_buckets = buckets_for(n_rows)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    # the error stays well below a bucket's share of the rows
    splits = sorted(set(df.approxQuantile(col, probs, min(0.01, 0.25 / n_buckets))))
    edges = [float("-inf"), *[float(s) for s in splits], float("inf")]

    def _apply(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("__bk", F.col(col).cast("double"))
        out = Bucketizer(splits=edges, inputCol="__bk", outputCol="__bd").transform(frame)
        return out.withColumn("__b", F.col("__bd").cast("long")).drop("__bk", "__bd")

    return Bucketing(len(edges) - 1, transform=_apply)


def running_offsets(
    df: DataFrame,
    order_cols: list[str | Column],
    bucketing: Bucketing,
    *,
    partition_cols: tuple[str, ...] = (),
    weight: Column | None = None,
    out: str = "pos",
    inclusive: bool = False,
    total: str | None = None,
) -> DataFrame:
    """Add ``out`` = running count (or running sum of ``weight``) in order, per group.

    Exclusive by default: the first row of each group gets 0. ``total`` names a column for the
    group's whole sum, which the table of bases knows. The join with the bases uses
    the partitioning that the window needs anyway; whether it is a broadcast is Spark's
    decision by the size of the base table.
    """
    w_col = F.lit(1).cast("long") if weight is None else weight.cast("long")
    pcols = list(partition_cols)
    tagged = bucketing.apply(df).withColumn("__w", w_col)

    sums = tagged.groupBy(*pcols, "__b").agg(F.sum("__w").alias("__bw"))
    base_win = Window.partitionBy(*pcols).orderBy("__b") if pcols else Window.orderBy("__b")
    whole = [F.sum("__bw").over(Window.partitionBy(*pcols)).alias(total)] if total else []
    bases = sums.select(*pcols, "__b", (F.sum("__bw").over(base_win) - F.col("__bw")).alias("__base"), *whole)

    joined = tagged.join(bases, on=[*pcols, "__b"], how="inner")
    inner = Window.partitionBy(*pcols, "__b").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = F.sum("__w").over(inner) + F.col("__base")
    if not inclusive:
        running = running - F.col("__w")
    return joined.withColumn(out, running).drop("__b", "__w", "__base")


def global_positions(
    df: DataFrame,
    order_cols: list[str | Column],
    bucketing: Bucketing,
    *,
    partition_cols: tuple[str, ...] = (),
    out: str = "pos",
) -> DataFrame:
    """0-based position in order (per group). Order keys must be unique within a group."""
    return running_offsets(
        df, order_cols, bucketing, partition_cols=partition_cols, out=out
    )


def running_min(
    df: DataFrame,
    value: str,
    order_cols: list[str | Column],
    bucketing: Bucketing,
    *,
    partition_cols: tuple[str, ...] = (),
    out: str = "prev_min",
) -> DataFrame:
    """Minimum of ``value`` over all *earlier* rows of the group (NULL for the first row).

    Same two phases as the running sum: bucket minima, an exclusive running
    minimum over the small bucket table, then a window inside each bucket.
    """
    pcols = list(partition_cols)
    tagged = bucketing.apply(df)
    mins = tagged.groupBy(*pcols, "__b").agg(F.min(value).alias("__bm"))
    base_win = (Window.partitionBy(*pcols) if pcols else Window.partitionBy()).orderBy("__b").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = mins.select(*pcols, "__b", F.min("__bm").over(base_win).alias("__base"))
    joined = tagged.join(bases, on=[*pcols, "__b"], how="inner")
    inner = Window.partitionBy(*pcols, "__b").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.least(F.min(value).over(inner), F.col("__base"))
    return joined.withColumn(out, prev).drop("__b", "__base")


def top_n(df: DataFrame, n: int, score: str, tiebreak: list[str | Column], out: str = "rk") -> DataFrame:
    """Exact top ``n`` rows by ``score`` desc, then ``tiebreak`` asc, with rank ``out`` (1-based).

    A histogram of score values (one row per distinct score) gives the cut-off score and the
    number of rows above it. Rows above it are fewer than ``n``; of the rows at it, only the
    first by ``tiebreak`` that still fit are taken, a limit that every task applies to its own
    rows first. The last ranking sees exactly ``n`` rows. ``df`` is read three times.
    """
    hist = df.groupBy(score).agg(F.count("*").alias("__c"))
    above = F.sum("__c").over(Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1))
    seen = hist.select(score, F.coalesce(above, F.lit(0)).alias("__a")).where(F.col("__a") < n)
    cutoff, over = seen.agg(F.min(score), F.max("__a")).first()
    ties = df.where(F.col(score) == F.lit(cutoff)).orderBy(*tiebreak).limit(n - over if over is not None else 0)
    kept = df.where(F.col(score) > F.lit(cutoff)).unionByName(ties)
    w = Window.orderBy(F.desc(score), *tiebreak)
    return kept.withColumn(out, F.row_number().over(w))
