"""Weighted interleaving of named sources (C1–C6) in closed form.

A sequential interleaver draws a source with probability w per step and emits
that source's next row. Here every draw k is a generated row:

* ``u(k) = int(first 13 hex digits of md5(seed:k)) / 2^52``;
* ``src(k)`` = first source whose cumulative weight exceeds ``u(k)``;
* ``occ(k)`` = earlier draws of the same source (two-phase running count);
* ``k_s`` = the draw where source s reads its last row (``occ = n_s - 1``).

first_exhausted keeps ``k <= min k_s``; all_exhausted keeps ``k <= max k_s``
with row ``occ mod n_s`` (exhausted sources restart); the without-replacement
variant keeps ``k <= max k_s`` and ``occ < n_s`` (each row exactly once).

Draws are ``spark.range`` rows, so only narrow (k, source, occ) keys move
through the shuffles; text joins once at the end. A source much smaller than
its weight repeats its rows many times: the final join salts those rows so
no (source, row) key lands in one task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import options
from quire.functions import text as T
from quire.operators import offsets as O
from quire.session import stored
from quire.sources import registry as R

# The names of the three stopping rules.
STRATEGIES = ("all_exhausted", "first_exhausted", "all_exhausted_without_replacement")

# ---------------------------------------------------------------------------
# The three recommended mixes (genre -> weight), in the order
# the reference declares them.
# ---------------------------------------------------------------------------
PRESETS: dict[str, dict[str, float]] = {
    "small": {"wiki": 0.45, "textbook": 0.2, "web": 0.2, "literature": 0.1, "research": 0.05},
    "balanced": {"wiki": 0.35, "web": 0.3, "cc100": 0.2, "textbook": 0.1, "literature": 0.03, "research": 0.02},
    "web_heavy": {"web": 0.4, "cc100": 0.35, "wiki": 0.15, "textbook": 0.07, "literature": 0.02, "research": 0.01},
}

DRAWS_PER_PARTITION = 2_000_000
WEIGHT_SLACK = 1e-9  # of the sum of the weights
MAX_REPEATS_PER_KEY = 256  # salted join: at most this many draws share one (source, row, salt) key


def recommended_mix(preset: str = "balanced") -> dict[str, float]:
    """The weights of a preset (C1), as a new mapping."""
    options.check(preset=(preset, options.one_of(PRESETS)))
    return {**PRESETS[preset]}


def presets_frame(spark: SparkSession) -> DataFrame:
    rows = [(p, g, float(w)) for p, mix in PRESETS.items() for g, w in mix.items()]
    return spark.createDataFrame(rows, "preset string, genre string, weight double")


@dataclass(frozen=True)
class Choice:
    """What a caller wants to read: one source in stream order, or several by weight (``weights`` set)."""

    genres: tuple[str, ...]
    weights: tuple[float, ...] | None = None
    split: str = "train"

    @classmethod
    def of(cls, registry: R.SourceRegistry, wanted: str | Mapping[str, float], split: str = "train", strategy: str | None = None) -> Choice:
        """Read ``wanted`` against the registry (C2, C6); all that is wrong with it is told in one error."""
        by_weight = isinstance(wanted, Mapping)
        if not by_weight and not isinstance(wanted, str):
            raise TypeError(f"sources are chosen by a genre's name or by a mapping of genres to weights, not by {type(wanted).__name__}")
        genres = tuple(wanted) if by_weight else (wanted,)
        found = options.problems(split=(split, options.one_of(R.SPLITS)))
        found += options.problems(**{f"genre {g!r}": (g, options.one_of(registry.genres)) for g in genres})
        if not by_weight:
            options.reject(found)
            return cls(genres, None, split)
        if strategy is not None:
            found += options.problems(strategy=(strategy, options.one_of(STRATEGIES)))
        weights = tuple(map(float, wanted.values()))
        found += [f"the weight of {g!r} is {w}: a source that is mixed in needs some" for g, w in zip(genres, weights) if not w > 0]
        if abs(math.fsum(weights) - 1.0) > WEIGHT_SLACK:
            found.append(f"{len(weights)} weights add up to {math.fsum(weights):.12g} where shares of one whole are needed")
        options.reject(found)
        return cls(genres, weights, split)


def cumulative(weights: list[float]) -> list[float]:
    out, acc = [], 0.0
    for w in weights:
        acc += w
        out.append(acc)
    return out


def source_of(u: F.Column, cum: list[float]) -> F.Column:
    """Index of the first source whose cumulative weight exceeds u (the last one if none)."""
    expr = F.when(u < F.lit(cum[0]), F.lit(0))
    for i, c in enumerate(cum[1:], start=1):
        expr = expr.when(u < F.lit(c), F.lit(i))
    return expr.otherwise(F.lit(len(cum) - 1))


def draws(spark: SparkSession, n_draws: int, seed: int, cum: list[float]) -> DataFrame:
    """``(k, gi, occ)`` for draws 0..n-1."""
    parts = max(1, -(-n_draws // DRAWS_PER_PARTITION))
    d = spark.range(0, n_draws, 1, parts).withColumnRenamed("id", "k")
    d = d.withColumn("gi", source_of(T.uniform01(seed, "k"), cum))
    bk = O.position_bucketing("k", n_draws, spark)
    return O.global_positions(d, ["k"], bk, partition_cols=("gi",), out="occ")


def _n_expr(ns: list[int]) -> F.Column:
    return F.element_at(F.array(*[F.lit(int(n)) for n in ns]), F.col("gi") + 1)


def exhaustion_points(
    spark: SparkSession, counts: list[int], weights: list[float], seed: int, first_only: bool = False
) -> tuple[DataFrame, list[int | None]]:
    """The draws ``(k, gi, occ)``, a written table, and ``k_s`` per source (None: not reached). Starts near the
    expected number of draws and doubles until every source, or with ``first_only`` any source, has been read
    to its end. The mix reads its draws from the same table."""
    cum = cumulative(weights)
    expected = [c / w for c, w in zip(counts, weights)]
    n = math.ceil(1.2 * (min(expected) if first_only else max(expected))) + 1000
    while True:
        d = stored(draws(spark, n, seed, cum), "draws")
        rows = d.where(F.col("occ") == _n_expr(counts) - 1).groupBy("gi").agg(F.min("k").alias("ks")).collect()
        ks = {r["gi"]: r["ks"] for r in rows}
        if len(ks) == len(counts) or first_only and ks:
            return d, [ks.get(i) for i in range(len(counts))]
        n *= 2


@dataclass
class MixPlan:
    """The narrow mixed stream and what is needed to attach document payloads.

    ``rows``: ``(k, pos, gi, genre, occ, doc_id, salt)``, one row per emitted
    draw, ``pos`` dense in ``[0, n)``. No text has moved yet.
    """

    rows: DataFrame
    n: int
    genres: list[str]
    salts: list[int]

    def salt_of(self, k: F.Column, genre: F.Column) -> F.Column:
        return F.pmod(k, _per_genre(self.genres, self.salts, genre))

    def attach(self, stream: DataFrame, payload: DataFrame) -> DataFrame:
        """Join per-document columns (``payload``: ``doc_id, genre, ...``) onto
        stream rows (``doc_id, genre, salt, ...``). Documents of an
        oversampled genre are replicated once per salt value, so no
        ``(doc_id, salt)`` key carries more than MAX_REPEATS_PER_KEY rows."""
        if max(self.salts) > 1:
            n_salt = _per_genre(self.genres, self.salts, F.col("genre"))
            payload = payload.withColumn("salt", F.explode(F.sequence(F.lit(0), n_salt - 1)))
        else:
            payload = payload.withColumn("salt", F.lit(0))
        return stream.join(payload, on=["genre", "doc_id", "salt"], how="inner")


def _per_genre(genres: list[str], values: list[int], genre: F.Column) -> F.Column:
    return F.element_at(F.create_map(*[x for g, v in zip(genres, values) for x in (F.lit(g), F.lit(v))]), genre)


def interleave_plan(
    spark: SparkSession,
    sources: DataFrame,
    genres: list[str],
    weights: list[float],
    *,
    seed: int = 42,
    strategy: str,
) -> MixPlan:
    """Plan the mixed stream on narrow columns only.

    ``sources`` needs ``(doc_id, genre)``; rows of a genre are read in
    ``doc_id`` order. The output size is known from the exhaustion points, so
    no job counts it: the cut plus one draw for the first / all exhausted
    rules, every source row once without replacement.
    """
    options.check(strategy=(strategy, options.one_of(STRATEGIES)))
    narrow = sources.select("doc_id", "genre")
    counted = {r["genre"]: r["n"] for r in narrow.groupBy("genre").agg(F.count("*").alias("n")).collect()}
    counts = [int(counted.get(g, 0)) for g in genres]
    options.reject([f"source {g!r} has no rows to draw" for g, c in zip(genres, counts) if not c])
    first = strategy == "first_exhausted"
    d, ks = exhaustion_points(spark, counts, weights, seed, first)
    cut = min(k for k in ks if k is not None) if first else max(ks)
    d = d.where(F.col("k") <= cut)  # earlier draws do not depend on later ones
    n_col = _n_expr(counts)
    if strategy == "all_exhausted":
        d = d.withColumn("row", F.pmod(F.col("occ"), n_col))
        n_rows = cut + 1
    elif strategy == "first_exhausted":
        d = d.withColumn("row", F.col("occ"))  # k <= min k_s never passes a source's end
        n_rows = cut + 1
    else:
        d = d.where(F.col("occ") < n_col).withColumn("row", F.col("occ"))
        n_rows = sum(counts)
    d = d.withColumn("genre", F.element_at(F.array(*[F.lit(g) for g in genres]), F.col("gi") + 1))

    # salt sources whose rows repeat more than MAX_REPEATS_PER_KEY times
    salts = [max(1, math.ceil(w * (cut + 1) / c / MAX_REPEATS_PER_KEY)) for w, c in zip(weights, counts)]
    plan = MixPlan(d, n_rows, list(genres), salts)
    d = d.withColumn("salt", plan.salt_of(F.col("k"), F.col("genre")))

    ranked = O.global_positions(
        narrow, ["doc_id"], O.quantile_bucketing(narrow, "doc_id", sum(counts)),
        partition_cols=("genre",), out="row",
    )
    if max(salts) > 1:
        ranked = ranked.withColumn("salt", F.explode(F.sequence(F.lit(0), _per_genre(genres, salts, F.col("genre")) - 1)))
    else:
        ranked = ranked.withColumn("salt", F.lit(0))
    rows = d.join(ranked, on=["genre", "row", "salt"], how="inner")
    if strategy == "all_exhausted_without_replacement":
        # skipped draws leave gaps in k: dense positions from the narrow rows
        bk = O.position_bucketing("k", cut + 1, spark)
        rows = O.global_positions(rows, ["k"], bk, out="pos")
    else:
        rows = rows.withColumn("pos", F.col("k"))
    plan.rows = rows.select("k", "pos", "gi", "genre", "occ", "doc_id", "salt")
    return plan


def interleave(
    spark: SparkSession,
    sources: DataFrame,
    genres: list[str],
    weights: list[float],
    *,
    seed: int = 42,
    strategy: str,
    payload: DataFrame | None = None,
) -> DataFrame:
    """Mixed stream (C3–C5): ``(k, pos, genre, occ, doc_id, text)``; ``k`` orders the output.

    ``sources`` holds ``(doc_id, genre, text)``. The strategy is a required
    argument (the reference's two entry points default differently). Text is
    attached once, by the salted join of :meth:`MixPlan.attach`. ``payload`` (doc_id, genre, ...)
    stands in for the text: what is worked out per document need not be worked out per draw.
    """
    plan = interleave_plan(spark, sources, genres, weights, seed=seed, strategy=strategy)
    payload = sources.select("doc_id", "genre", "text") if payload is None else payload
    out = plan.attach(plan.rows, payload)
    return out.select("k", "pos", "genre", "occ", "doc_id", *[c for c in payload.columns if c not in ("doc_id", "genre")])


def mixed(
    spark: SparkSession,
    registry: R.SourceRegistry,
    genre: str | Mapping[str, float],
    *,
    split: str = "train",
    seed: int = 42,
    strategy: str,
    payload: DataFrame | None = None,
) -> DataFrame:
    """Entry point: the rows of one source (C6), or several sources interleaved by weight.

    ``payload``: see :func:`interleave`; one source alone is read as it is."""
    choice = Choice.of(registry, genre, split, strategy)
    if choice.weights is None:
        return R.read_source(spark, registry, choice.genres[0], choice.split)
    sources = R.read_sources(spark, registry, list(choice.genres), choice.split)
    return interleave(spark, sources, list(choice.genres), list(choice.weights), seed=seed, strategy=strategy, payload=payload)


def realised_shares(mixed_tokens: DataFrame) -> DataFrame:
    """Share of documents and of tokens per genre in a mixed stream (weights mix
    documents, not tokens). ``mixed_tokens``: ``(genre, n_ids)`` per stream row."""
    per = mixed_tokens.groupBy("genre").agg(F.count("*").alias("n_docs"), F.sum("n_ids").cast("long").alias("n_tokens"))
    every = Window.partitionBy()  # over the per-genre table: one row per genre
    return per.select(
        "genre", "n_docs", "n_tokens",
        F.round(F.col("n_docs") / F.sum("n_docs").over(every), 6).alias("doc_share"),
        F.round(F.col("n_tokens") / F.sum("n_tokens").over(every), 6).alias("token_share"),
    )
