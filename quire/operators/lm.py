"""Count-based next-token model (H1): bigram counts with add-alpha smoothing.

It stands in for the neural scorer so that evaluation and decoding steps
have token scores: ``nll(a, b) = -ln((c(a,b) + alpha) / (c(a) + alpha * V))``.
Fitting is one aggregation with a map-side partial aggregate; scoring first
aggregates the pairs to score, then joins them to the counts, so hot pairs
are counted once per partition instead of joined once per occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.session import shared_path

MAX_BROADCAST_CONTEXTS = 5_000_000


def sequence_pairs(ids: Column, frame: bool = True, eos: int = T.EOS_ID) -> Column:
    """array<struct<a,b>> of consecutive tokens; framed as EOS + ids + EOS.

    Built from two slices zipped together, so each array is read once (a
    lambda indexing an outer array would re-evaluate it per element).
    """
    seq = F.concat(F.array(F.lit(eos)), ids, F.array(F.lit(eos))) if frame else ids
    n = F.size(seq) - 1
    return F.arrays_zip(F.slice(seq, 1, n).alias("a"), F.slice(seq, 2, n).alias("b"))


def fit_bigram(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``(a, b, cnt)`` over every document's framed token sequence, written once to the shared
    folder: totals, scores and candidates read the table, not the corpus again."""
    pairs = encoded.select(F.explode(sequence_pairs(F.col(ids_col))).alias("p")).where(F.col("p.b").isNotNull())
    counts = pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("cnt"))
    path = shared_path(encoded.sparkSession, "bigrams")
    counts.write.parquet(path)
    return encoded.sparkSession.read.schema(counts.schema).parquet(path)


def context_totals(model: DataFrame) -> DataFrame:
    """``(a, ca)``: how often ``a`` is followed by anything. At most V rows."""
    return model.groupBy("a").agg(F.sum("cnt").alias("ca"))


def log_prob(cnt: Column, ca: Column, alpha: float, vocab: int) -> Column:
    return F.ln((F.coalesce(cnt, F.lit(0)) + F.lit(alpha)) / (F.coalesce(ca, F.lit(0)) + F.lit(alpha * vocab)))


def _totals_side(model: DataFrame, vocab: int) -> DataFrame:
    """Per-context totals: one row per vocabulary entry at most, so broadcast
    only while the vocabulary is within the bound."""
    ca = context_totals(model)
    return F.broadcast(ca) if vocab <= MAX_BROADCAST_CONTEXTS else ca


def with_log_prob(model: DataFrame, alpha: float, vocab: int) -> DataFrame:
    return model.join(_totals_side(model, vocab), "a").withColumn("logp", log_prob(F.col("cnt"), F.col("ca"), alpha, vocab))


def score_pairs(pairs: DataFrame, model: DataFrame, alpha: float, vocab: int, keys: tuple[str, ...]) -> DataFrame:
    """Sum of nll per ``keys`` for rows ``(*keys, a, b)``; also the token count.

    Pairs are pre-aggregated to ``(*keys, a, b, n)`` before the join, and the
    per-context totals (bounded by the vocabulary) are broadcast.
    """
    agg = pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    j = agg.join(model, ["a", "b"], "left").join(_totals_side(model, vocab), "a", "left")
    nll = -log_prob(F.col("cnt"), F.col("ca"), alpha, vocab) * F.col("n")
    return j.groupBy(*keys).agg(F.sum(nll).alias("nll"), F.sum("n").alias("n_tokens"))
