"""Operator 4, mixing sources to target weights by capped water-filling.

A budget of words is shared over the sources by weight. A source may give at most
``max_epochs`` times its own size; what it cannot take is reshared by weight among the
others until no target is above its cap. In closed form: order the sources by
cap / weight; with P the caps before a source and W the weights from it on, the level
(budget - P) / W is the water line of the first source whose cap / weight is above it.

A source's target is met by whole repetitions of all its documents and, for the
fraction that remains, by documents in a seeded order until the words suffice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACE_WORDS, expand, materialise, running_sum

SEED = "mix-7"
CYCLE = (3, 1, 2)
BUCKET_DIGITS = 3  # 4096 ordered buckets per source


def source_targets(sizes: DataFrame, share: float, max_epochs: float, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """source, source_size, target per source from (source, source_size) rows.

    Weights follow ``cycle`` over the sources by code point, null last. The table has one
    row per source; its two windows run over these pre-aggregated rows only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    t = sizes.withColumn("weight", F.get(weights, (F.row_number().over(by_name) - 1) % len(cycle)))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    level_order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level_order.rowsBetween(Window.unboundedPreceding, -1)
    after = level_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level)
    # the water line is the level of the first source in this order that it does not fill; levels fall after it
    full = F.col("cap") / F.col("weight") <= F.col("level")
    line = F.max(F.when(~full, F.col("level"))).over(everything)
    target = F.when(full | line.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), line * F.col("weight")))
    return t.select("source", "source_size", target.alias("target"))


def record_key(docs: DataFrame, every_column: bool = False) -> Column:
    """md5 that names a record: rows alike in doc_id, source and text (or in every column) are interchangeable."""
    names = ["doc_id", "source", *(c for c in docs.columns if every_column and c not in ("doc_id", "source", "text"))]
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in names]
    text = F.coalesce(F.concat(F.lit("="), F.col("text").cast("string")), F.lit(""))
    return F.md5(F.concat_ws("\u001f", *parts, F.md5(text.cast("binary"))).cast("binary"))


def record_sizes(docs: DataFrame, seed: str = SEED, every_column: bool = False) -> DataFrame:
    """One row per record with its size, number of copies and seeded order key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(SPACE_WORDS)).cast("long")
    order = F.md5(
        F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary")
    )
    rows = docs.select(record_key(docs, every_column).alias("record"), "doc_id", "source", size.alias("size"), order.alias("order_key"))
    rec = rows.groupBy("record", "doc_id", "source", "size", "order_key").agg(F.count("*").alias("copies"))
    return rec.withColumn("record_words", F.col("size") * F.col("copies"))


def plan_mix(
    docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, cycle: tuple[int, ...] = CYCLE,
    seed: str = SEED, whole_documents: bool = False, every_column: bool = False,
) -> DataFrame:
    """One row per record: record, doc_id, source, size, copies, source_size, target, epochs, left.

    ``epochs`` whole repetitions are the whole part of target / source_size. ``left`` words of
    the fraction are still open when the record's first copy is reached in the seeded order.

    Rows alike in id, source and text are one record with a multiplicity, so hot copies do
    not meet in one task; a hot source is cut into 4096 ordered hash buckets.
    Null or blank text: size 0. Null source: a source of its own, last in order. A source of
    size 0: target 0. Empty table: no rows. Reruns agree: only ids, texts, sources and the
    seed decide. Other columns are not read.
    """
    rec = materialise(record_sizes(docs, seed, every_column), "mix-records")
    sizes = rec.groupBy("source").agg(F.sum("record_words").alias("source_size"))
    targets = source_targets(sizes, share, max_epochs, cycle)
    rec = rec.withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS))
    run = running_sum(rec, ["source"], "bucket", ["order_key", "record"], "record_words", "words_before").drop("bucket")
    rows = run.alias("l").join(targets.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select(
        "l.*", "r.source_size", "r.target"
    )
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs)
    left = goal - F.col("epochs") * F.col("source_size") - F.col("words_before")
    return rows.select("record", "doc_id", "source", "size", "copies", "source_size", "target", "epochs", left.alias("left"))


def taken_words(plan: DataFrame) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken, epochs, source.

    The document at the edge of the fraction gives the leading words that are still missing,
    so a source's taken words equal its rounded target. No document gives more than
    ``max_epochs`` x size.
    """
    rows = expand(plan, "copies", "copy")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("left") - F.col("copy") * F.col("size")))
    taken = F.col("epochs") * F.col("size") + extra
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "epochs", "source")


def mix_documents(
    docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, cycle: tuple[int, ...] = CYCLE, seed: str = SEED
) -> DataFrame:
    """The mixed corpus: every document repeated as the plan says, with the columns of ``docs``.

    Whole documents only: the one at the edge of a fraction is in or out, whichever brings its
    source nearer to the target. A source whose target is below its size leaves documents out
    by the seeded order, one above it repeats them. Empty documents weigh nothing and stay.
    """
    plan = plan_mix(docs, share, max_epochs, cycle, seed, every_column=True)
    # copies of a record that still fit into the open words, the edge one by the nearer side
    fit = F.greatest(F.lit(0).cast("long"), F.least(F.col("copies"), F.round(F.col("left") / F.col("size")).cast("long")))
    reps = F.when(F.col("size") == 0, F.col("copies")).otherwise(F.col("epochs") * F.col("copies") + fit)
    reps = plan.select(F.col("record").alias("__record"), reps.alias("__reps"))
    keyed = docs.withColumn("__record", record_key(docs, every_column=True)).dropDuplicates(["__record"])
    return expand(keyed.join(reps, "__record"), "__reps", "__copy").select(*docs.columns)
