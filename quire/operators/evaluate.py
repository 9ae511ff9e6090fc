"""Evaluation and run metrics.

Losses follow the trainer: a batch loss is the mean over its non-ignored
tokens; an update averages ``accumulate`` batch means (not token-weighted)
and an incomplete last group never updates; log-perplexity is token-weighted
over at most N batches, and "no tokens" reports -100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import offsets as O

NO_TOKENS = -100.0


def eval_pairs(rows: DataFrame, keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Scored positions of collated rows: input token a predicts the shifted label b.

    ``rows`` has ``input_ids`` and ``labels`` (unshifted, pad -> ignore). The
    shift happens here, at use (G9); ignored labels are dropped (H6).
    """
    n = F.size("input_ids") - 1
    pairs = F.arrays_zip(F.slice("input_ids", 1, n).alias("a"), F.slice("labels", 2, n).alias("b"))
    ex = rows.select(*keys, F.explode(pairs).alias("p"))
    return ex.select(*keys, F.col("p.a").alias("a"), F.col("p.b").alias("b")).where(
        F.col("b").isNotNull() & (F.col("b") != T.IGNORE_INDEX)
    )


def batch_loss(scored: DataFrame) -> DataFrame:
    """Mean loss per batch (H2) from ``(batch_id, nll, n_tokens)``."""
    return scored.select("batch_id", (F.col("nll") / F.col("n_tokens")).alias("loss"))


def update_loss(batch_losses: DataFrame, accumulate: int) -> DataFrame:
    """Mean of batch means per update (H3); only complete groups update."""
    g = batch_losses.groupBy(F.floor(F.col("batch_id") / accumulate).cast("long").alias("update_id"))
    return g.agg(F.avg("loss").alias("loss"), F.count("*").alias("n")).where(F.col("n") == accumulate).drop("n")


def log_perplexity(nll_sum: Column, n_tokens: Column) -> Column:
    """Token-weighted log-perplexity (H4, H5); -100 when there are no tokens."""
    return F.when(F.coalesce(n_tokens, F.lit(0)) > 0, nll_sum / n_tokens).otherwise(F.lit(NO_TOKENS))


def best_so_far(metrics: DataFrame, bucketing: O.Bucketing, *, exclude_no_tokens: bool = True) -> DataFrame:
    """Best-so-far flag (H7): strictly below every earlier value of the same
    tag (the first value always wins against +inf; ties do not). The running
    minimum uses two phases, so one dominant tag is still spread over buckets.
    ``metrics``: ``(tag, step, value)``.

    Every row comes back. A value that says nothing (null, NaN and, by default, the
    no-tokens mark) is never the best and does not lower the minimum.
    """
    said = F.col("value").isNotNull() & ~F.isnan("value")
    if exclude_no_tokens:
        said = said & (F.col("value") != F.lit(NO_TOKENS))
    m = metrics.withColumn("__v", F.when(said, F.col("value")))
    prev = O.running_min(m, "__v", ["step"], bucketing, partition_cols=("tag",))
    best = F.col("__v").isNotNull() & (F.col("prev_min").isNull() | (F.col("__v") < F.col("prev_min")))
    return prev.withColumn("is_best", best).drop("prev_min", "__v")


def metric_long(wide: DataFrame, step_col: str, tags: dict[str, str], run: str | None = None) -> DataFrame:
    """Wide per-step scalars to the long ``(step, tag, value)`` log (A9) via ``unpivot``."""
    cols = [F.col(c).cast("double").alias(t) for c, t in tags.items()]
    w = wide.select(F.col(step_col).cast("long").alias("step"), *cols)
    long = w.unpivot("step", list(tags.values()), "tag", "value")
    return long.withColumn("run", F.lit(run)) if run is not None else long


def metric_log(train: DataFrame, interval: int, evaluation: DataFrame | None = None, train_tag: str = "Loss/Train", val_tag: str = "Loss/Validation") -> DataFrame:
    """Per-step training rows plus validation rows every ``interval`` steps (H8).

    ``train``: ``(step, value)``. ``evaluation``: ``(step, value)`` as measured; its rows of
    checkpoint steps, ``(step + 1) % interval == 0``, are logged. Without one, a checkpoint
    step logs the mean training value of the ``interval`` steps that end with it.
    """
    tr = train.select("step", F.lit(train_tag).alias("tag"), "value")
    if evaluation is None:
        end = (F.floor(F.col("step") / interval) + 1) * interval - 1
        spans = train.groupBy(end.cast("long").alias("step")).agg(F.avg("value").alias("value"), F.max("step").alias("last"))
        evaluation = spans.where(F.col("last") == F.col("step")).drop("last")
    at = evaluation.where(F.pmod(F.col("step") + 1, F.lit(interval)) == 0)
    return tr.unionByName(at.select("step", F.lit(val_tag).alias("tag"), "value"))


def sample_log(train: DataFrame, interval: int, samples: DataFrame, tag: str = "Sample") -> DataFrame:
    """Text-valued rows of the metric log (A9, H8): at every checkpoint step one row per sample,
    ``(step, tag, value, text)`` with the tag ``Sample/<name>`` and no value.

    ``samples`` has ``(step, name, text)``: the text generated for each fixed prompt at that step;
    a null step stands for every checkpoint. ``train``: ``(step, ...)``, the steps of the run.
    """
    at = train.where(F.pmod(F.col("step") + 1, F.lit(interval)) == 0).select("step").distinct()
    own = samples.where(F.col("step").isNotNull()).join(at, "step")
    # the fixed prompts are few: as an array they meet each checkpoint without a join of pairs
    fixed = samples.where(F.col("step").isNull()).agg(F.sort_array(F.collect_list(F.struct("name", "text"))).alias("s")).first()["s"]
    made = [F.struct(F.lit(r["name"]).alias("name"), F.lit(r["text"]).alias("text")) for r in fixed or []]
    rows = own.select("step", "name", "text")
    if made:
        rows = rows.unionByName(at.select("step", F.explode(F.array(*made)).alias("s")).select("step", "s.name", "s.text"))
    label = F.concat(F.lit(f"{tag}/"), F.col("name").cast("string"))
    return rows.select("step", label.alias("tag"), F.lit(None).cast("double").alias("value"), "text")
