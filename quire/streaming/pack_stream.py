"""Streaming pack (J1-J3) and streaming metric log with best-so-far.

A sequential loader carries a token buffer per worker from document to document. Here a
stream is read in *arrivals*: one run of the streaming query over all that is new (its
checkpoint makes that exactly once) stages the new rows, and a batch plan over the arrival
continues where the last one ended. What lives between arrivals is a small *ledger*:

* packing: per shard the next block, the tokens after the last full block (at most a block's
  length) and the documents counted so far. Within the arrival, token offsets come from the
  two-phase running sum and blocks are put together per (shard, block), so a shard is never
  one task, however much of the stream it holds;
* metrics: per tag the least value so far. Within the arrival, minima of ranges of steps
  are merged first, so a tag is never one task either.

An arrival's output and ledger entry are written under its number, the ledger last: a run
that was cut short is simply done again and replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire import options
from quire.functions import text as T
from quire.operators import offsets as O
from quire.operators import pack as G
from quire.operators.evaluate import NO_TOKENS
from quire.session import stored

BLOCKS = "shard int, block_id long, input_ids array<int>, labels array<int>, attention_mask array<tinyint>"
LEDGER = "shard int, next_block long, tail array<int>, n_samples long"
BEST = "tag string, best double"


def run_available(spark: SparkSession, stream_df: DataFrame, sink_dir: str, checkpoint_dir: str, *partitions: str) -> None:
    """Run a streaming plan over all available input into a parquet sink."""
    q = (
        stream_df.writeStream.format("parquet")
        .partitionBy(*partitions)
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names inside a folder of whatever file system it is on; none if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def arrivals(spark: SparkSession, base: str) -> int:
    """Arrivals that are done: the numbers 0, 1, ... that have a written ledger entry."""
    done = [n for n in _names(spark, f"{base}/ledger") if n.startswith("arrival=")]
    return sum("_SUCCESS" in _names(spark, f"{base}/ledger/{n}") for n in done)


def _continued(spark: SparkSession, stream: DataFrame, base: str, ledger: str, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> None:
    """One arrival: stage what is new in ``stream``, then ``step`` (rows, ledger before) -> (output, ledger after)."""
    k = arrivals(spark, base)
    run_available(spark, stream.withColumn("arrival", F.lit(k)), f"{base}/staged", f"{base}/checkpoint", "arrival")
    kinds = StructType([*stream.schema.fields, StructField("arrival", IntegerType())])
    staged = _names(spark, f"{base}/staged")  # nothing, if nothing has ever arrived
    rows = spark.read.schema(kinds).parquet(f"{base}/staged").where(F.col("arrival") == k) if staged else spark.createDataFrame([], kinds)
    rows = rows.drop("arrival")
    before = spark.read.schema(ledger).parquet(f"{base}/ledger/arrival={k - 1}") if k else spark.createDataFrame([], ledger)
    out, after = step(rows, before)
    out.write.mode("overwrite").parquet(f"{base}/out/arrival={k}")
    after.write.mode("overwrite").parquet(f"{base}/ledger/arrival={k}")


def _done(spark: SparkSession, base: str, schema: str, folder: str = "out") -> DataFrame:
    """The output of all arrivals that are in the ledger."""
    paths = [f"{base}/{folder}/arrival={k}" for k in range(arrivals(spark, base))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


# --------------------------------------------------------------------------- packing


def pack_arrival(
    spark: SparkSession,
    stream: DataFrame,
    seq_length: int,
    base: str,
    *,
    add_eos: bool = True,
    eos_id: int = T.EOS_ID,
    max_samples: int | None = None,
) -> None:
    """Pack all that is new in the ``(shard, pos, ids)`` stream, in the order of ``pos`` within the arrival.

    ``max_samples`` counts the documents of a shard over all arrivals (J3). Read the blocks with
    :func:`packed_blocks`. The folder ``base`` belongs to one stream.
    """
    options.check(seq_length=(seq_length, options.COUNT), max_samples=(max_samples, options.COUNT_OR_NONE))

    def step(rows: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        return _packed(rows.select("shard", "pos", "ids"), before, seq_length, eos_id if add_eos else None, max_samples)

    _continued(spark, stream, base, LEDGER, step)


def _packed(rows: DataFrame, before: DataFrame, S: int, eos_id: int | None, max_samples: int | None) -> tuple[DataFrame, DataFrame]:
    spark = rows.sparkSession
    docs = rows.where(F.size("ids") > 0)
    lo, hi = docs.agg(F.min("pos"), F.max("pos")).first()
    bucketing = O.position_bucketing("pos", (hi if hi is not None else 0) + 1, spark)
    if lo is not None and lo > 0:
        bucketing = O.dense_range_bucketing("pos", lo, hi, O.buckets_for(hi - lo + 1, spark.sparkContext.defaultParallelism))
    if max_samples is not None:
        # ranked without the token arrays, in shards that still take documents; one row per shard cuts the rows
        counted = before.select("shard", F.col("n_samples").alias("__n"))
        narrow = docs.select("shard", "pos").join(F.broadcast(counted), "shard", "left")
        narrow = narrow.where(F.coalesce("__n", F.lit(0)) < max_samples)
        ranked = O.global_positions(narrow, ["pos"], bucketing, partition_cols=("shard",), out="__k")
        within = ranked.where(F.col("__k") + F.coalesce("__n", F.lit(0)) < max_samples)
        last = within.groupBy("shard").agg(F.max("pos").alias("__last"))
        docs = docs.join(F.broadcast(last), "shard").where(F.col("pos") <= F.col("__last")).select(*docs.columns)
    toks = F.concat("ids", F.array(F.lit(eos_id))) if eos_id is not None else F.col("ids")
    docs = docs.select("shard", "pos", toks.alias("toks"))
    # what the last arrival left over comes first
    rest = before.where(F.size("tail") > 0).select("shard", F.lit(-1).cast("long").alias("pos"), F.col("tail").alias("toks"))
    every = stored(docs.select("shard", F.col("pos").cast("long").alias("pos"), "toks").unionByName(rest), "arrival")
    lengths = every.select("shard", "pos", F.size("toks").alias("L"))
    # the left-over tokens belong to the first bucket
    first = bucketing.expr if lo is None else F.when(F.col("pos") < 0, F.lit(-1).cast("long")).otherwise(bucketing.expr)
    offsets = stored(G.narrow_offsets(lengths, O.Bucketing(bucketing.max_buckets + 1, expr=first)), "arrival-offsets")
    laid = every.withColumn("doc_id", F.col("pos")).join(offsets, ["shard", "pos"])
    blocks = G.cut_blocks(laid, S, drop_last=True)
    base = before.select("shard", "next_block")
    numbered = blocks.join(base, "shard", "left")
    out = numbered.select(
        "shard", (F.col("block_id") + F.coalesce("next_block", F.lit(0))).alias("block_id"), "input_ids", "labels", "attention_mask"
    )
    # the ledger: tokens from the last full block on, from the few documents that reach into it
    done = F.greatest(F.floor((F.col("T") - 1) / S), F.lit(0)).cast("long") * S
    reach = offsets.where(F.col("start") + F.col("L") > done).select("shard", "pos", "start", done.alias("done"))
    left = every.join(reach, ["shard", "pos"]).select(
        "shard", F.struct("start", F.slice("toks", (F.greatest(F.col("done") - F.col("start"), F.lit(0)) + 1).cast("int"), F.lit(S)).alias("t")).alias("p")
    )
    tail = left.groupBy("shard").agg(F.array_sort(F.collect_list("p")).alias("ps")).select("shard", F.flatten(F.transform("ps", lambda p: p["t"])).alias("tail"))
    seen = offsets.groupBy("shard").agg(
        F.max("T").alias("T"), F.sum(F.when(F.col("pos") >= 0, 1).otherwise(0)).cast("long").alias("new")
    )
    after = seen.join(tail, "shard", "left").join(before.drop("tail"), "shard", "full").select(
        F.col("shard").cast("int").alias("shard"),
        (F.coalesce("next_block", F.lit(0)) + F.greatest(F.floor((F.coalesce("T", F.lit(1)) - 1) / S), F.lit(0))).cast("long").alias("next_block"),
        F.coalesce("tail", F.array().cast("array<int>")).alias("tail"),
        (F.coalesce("n_samples", F.lit(0)) + F.coalesce("new", F.lit(0))).cast("long").alias("n_samples"),
    )
    return out, after


def packed_blocks(spark: SparkSession, base: str, seq_length: int, *, drop_last: bool = True, pad_id: int = T.PAD_ID,
                  ignore_index: int = T.IGNORE_INDEX) -> DataFrame:
    """Full blocks of all arrivals plus, unless ``drop_last``, each shard's padded tail (J2): a stream has no
    end, so the tail is made of what the ledger holds now."""
    blocks = _done(spark, base, BLOCKS)
    k = arrivals(spark, base)
    if drop_last or not k:
        return blocks
    S, r = seq_length, F.size("tail")
    ledger = spark.read.schema(LEDGER).parquet(f"{base}/ledger/arrival={k - 1}").where(r > 1)
    padded = F.concat("tail", F.array_repeat(F.lit(pad_id), F.lit(S + 1) - r))
    tails = ledger.select("shard", F.col("next_block").alias("block_id"), padded.alias("padded"), r.alias("r")).select(
        "shard", "block_id", F.slice("padded", 1, S).alias("input_ids"),
        F.transform(F.slice("padded", 2, S), lambda x, i: F.when(i >= F.col("r") - 1, F.lit(ignore_index)).otherwise(x)).alias("labels"),
        F.concat(F.array_repeat(F.lit(1), F.col("r")), F.array_repeat(F.lit(0), F.lit(S) - F.col("r"))).cast("array<tinyint>").alias("attention_mask"),
    )
    return blocks.unionByName(tails)


# --------------------------------------------------------------------------- metrics


def best_arrival(spark: SparkSession, stream: DataFrame, base: str, *, exclude_no_tokens: bool = True) -> None:
    """Flag, among all that is new in the ``(tag, step, value)`` stream, the values below all before them.

    Every row comes back; null, NaN and (by default) no-tokens values are never the best. Read the
    rows with :func:`best_rows`.
    """

    def step(rows: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        said = F.col("value").isNotNull() & ~F.isnan("value")
        if exclude_no_tokens:
            said = said & (F.col("value") != F.lit(NO_TOKENS))
        # equal to NULL: a tag may have no name
        name = F.when(F.col("tag").isNull(), "n").otherwise(F.concat(F.lit("="), "tag"))
        m = rows.select("tag", "step", "value", F.when(said, F.col("value")).alias("said"), name.alias("name"))
        m = m.withColumn("silent", F.lit(float("inf")))
        values = m.withColumn("low", F.coalesce("said", "silent"))
        best = before.select(name.alias("name"), "best")
        flagged = O.running_min(values, "low", ["step"], O.quantile_bucketing(values, "step"), partition_cols=("name",), out="prev")
        flagged = flagged.join(best, "name", "left")
        least = F.least(F.coalesce("prev", "silent"), F.coalesce("best", "silent"))
        out = flagged.select("tag", "step", "value", (F.col("low") < least).alias("is_best"))
        new = m.groupBy("tag").agg(F.min("said").alias("best"))
        after = before.unionByName(new).groupBy("tag").agg(F.min("best").alias("best"))
        return out, after

    _continued(spark, stream, base, BEST, step)


def best_rows(spark: SparkSession, base: str) -> DataFrame:
    """``(tag, step, value, is_best)`` of all arrivals."""
    return _done(spark, base, "tag string, step long, value double, is_best boolean")
