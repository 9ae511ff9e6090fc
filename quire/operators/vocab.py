"""Vocabulary learning as distributed counting.

The learned piece tables are bounded by the requested vocabulary size, so
they are the only things that may be broadcast to the encoders.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import options
from quire.functions import text as T
from quire.operators import offsets as O
from quire.operators import suffixes as S
from quire.operators.merges import train_merges
from quire.session import stored

# Model names and the least vocabulary the trainer accepts.
SMALLEST_VOCABULARY = 100
MODEL_TYPES = ("unigram", "bpe", "word", "char")
FIRST_ID = T.FIRST_LEARNED_ID
PIECE_SCHEMA = "id int, piece string, score double, type string"


@dataclass(frozen=True)
class TrainingOptions:
    """Options of the vocabulary trainer (E1), checked when they are made."""

    vocab_size: int
    character_coverage: float = 0.9995
    model_type: str = "unigram"
    normalization_rule_name: str = "nmt_nfkc"

    def __post_init__(self) -> None:
        options.check(
            vocab_size=(self.vocab_size, options.at_least(SMALLEST_VOCABULARY)),
            character_coverage=(self.character_coverage, options.SHARE),
            model_type=(self.model_type, options.one_of(MODEL_TYPES)),
            normalization_rule_name=(self.normalization_rule_name, options.TEXT),
        )


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, cnt) over whitespace words; partial aggregation runs map-side."""
    return (
        texts.select(F.explode(T.words(F.col(text_col))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("cnt"))
    )


def word_vocabulary(texts: DataFrame, vocab_size: int, text_col: str = "text") -> DataFrame:
    """Learned word pieces (E4): ``(id, word, piece, cnt)``, most frequent first.

    Ties break on the word (binary order). User-defined symbols are not
    learned: they already own ids. The cut is exact (:func:`offsets.top_n`).
    """
    counts = stored(word_counts(texts, text_col), "words").where(~F.col("word").isin(*T.USER_DEFINED))
    return _learned_words(counts, vocab_size)


def _learned_words(counts: DataFrame, vocab_size: int) -> DataFrame:
    top = O.top_n(counts, vocab_size, "cnt", [F.asc("word")])
    return top.select(
        (F.col("rk") + F.lit(T.FIRST_LEARNED_ID - 1)).cast("int").alias("id"),
        "word",
        F.concat(F.lit(T.WORD_BOUNDARY), F.col("word")).alias("piece"),
        F.col("cnt").cast("long").alias("cnt"),
    )


def char_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return (
        texts.select(F.explode(T.chars(F.col(text_col))).alias("ch"))
        .where(F.col("ch") != "")
        .groupBy("ch")
        .agg(F.count("*").alias("cnt"))
    )


def weighted_char_counts(words_df: DataFrame, word_col: str = "w", cnt_col: str = "cnt") -> DataFrame:
    """(ch, cnt): characters of a (word, count) table, each weighted by its word's count."""
    ex = words_df.select(F.explode(T.chars(F.col(word_col))).alias("ch"), F.col(cnt_col).alias("c"))
    return ex.where(F.col("ch") != "").groupBy("ch").agg(F.sum("c").cast("long").alias("cnt"))


def alphabet_from_counts(counts: DataFrame, coverage: float = 0.9995) -> DataFrame:
    """Characters kept by coverage (E2) from a ``(ch, cnt)`` table: most frequent
    first while the share of all characters *before* a character is below
    ``coverage``. The comparison runs on integers (count x 10^6), so it is
    exact. The table holds distinct code points only (bounded by Unicode), so
    one ordered window over it is fine."""
    total = F.sum("cnt").over(Window.partitionBy())
    w = Window.orderBy(F.desc("cnt"), F.asc("ch")).rowsBetween(Window.unboundedPreceding, -1)
    scaled = int(round(coverage * 1_000_000))
    ranked = counts.select(
        "ch",
        F.col("cnt").cast("long").alias("cnt"),
        F.coalesce(F.sum("cnt").over(w), F.lit(0)).alias("before"),
        total.alias("total"),
        F.row_number().over(Window.orderBy(F.desc("cnt"), F.asc("ch"))).alias("rk"),
    )
    return ranked.where(F.col("before") * F.lit(1_000_000) < F.col("total") * F.lit(scaled))


def alphabet(texts: DataFrame, coverage: float = 0.9995, text_col: str = "text") -> DataFrame:
    """Alphabet of raw texts (E2), characters counted over the whole corpus."""
    return alphabet_from_counts(char_counts(texts, text_col), coverage)


def char_vocabulary(texts: DataFrame, coverage: float = 0.9995, text_col: str = "text") -> DataFrame:
    """Character pieces (E3): ``(id, piece, score, cnt)``, score = ln(share)."""
    kept = alphabet(texts, coverage, text_col)
    return kept.select(
        (F.col("rk") + F.lit(T.FIRST_LEARNED_ID - 1)).cast("int").alias("id"),
        F.col("ch").alias("piece"),
        F.ln(F.col("cnt") / F.col("total")).alias("score"),
        "cnt",
    )


def special_and_byte_pieces(spark: SparkSession) -> DataFrame:
    """Fixed head of every piece table (E7): specials 0–6, bytes 7–262."""
    rows = [(i, p, 0.0, t) for i, p, t in T.SPECIAL_PIECES]
    rows += [(T.BYTE_BASE + b, f"<0x{b:02X}>", 0.0, "BYTE") for b in range(256)]
    return spark.createDataFrame(rows, PIECE_SCHEMA)


def piece_table(spark: SparkSession, learned: DataFrame, score: F.Column | None = None) -> DataFrame:
    """Specials + bytes + learned pieces, as ``(id, piece, score, type)``."""
    sc = score if score is not None else F.lit(0.0)
    body = learned.select(
        F.col("id").cast("int").alias("id"), "piece", sc.cast("double").alias("score"), F.lit("NORMAL").alias("type")
    )
    return special_and_byte_pieces(spark).unionByName(body)


def word_piece_table(spark: SparkSession, texts: DataFrame, vocab_size: int) -> DataFrame:
    """Full piece table of the word model; learned score = ln(count / all words)."""
    counts = stored(word_counts(texts), "words")
    learned = _learned_words(counts.where(~F.col("word").isin(*T.USER_DEFINED)), vocab_size)
    total = counts.agg(F.sum("cnt")).scalar()  # one scalar subquery, no join
    return piece_table(spark, learned, F.ln(F.col("cnt") / total))


def pad_choice(pieces: DataFrame) -> DataFrame:
    """Pad id (F7): pad if present, else eos, else unk; a table with none of them is an error."""
    pick = lambda name: F.max(F.when(F.col("piece") == name, F.col("id")))
    none = F.raise_error(F.lit("the piece table has no <pad>, </s> or <unk> to pad with")).cast("int")
    return pieces.agg(pick("<pad>").alias("p"), pick("</s>").alias("e"), pick("<unk>").alias("u")).select(
        F.coalesce("p", "e", "u", none).alias("pad_id")
    )


def token_stats(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Mean and total tokens per document."""
    n = F.size(ids_col)
    return encoded.agg(
        F.count("*").alias("n_docs"),
        F.sum(n).cast("long").alias("total_tokens"),
        F.round(F.avg(n), 6).alias("mean_tokens"),
    )


# --------------------------------------------------------------------------- pair merges (E5)

OPEN, CLOSE = "\x02", "\x03"  # symbol brackets; never part of whitespace-split words


def symbol_string(word: F.Column) -> F.Column:
    """``▁word`` as bracketed symbols: one ``\\x02c\\x03`` per character."""
    return F.concat(
        F.array_join(F.transform(T.chars(F.concat(F.lit(T.WORD_BOUNDARY), word)), lambda c: F.concat(F.lit(OPEN), c, F.lit(CLOSE))), "")
    )


def _symbols(s: F.Column) -> F.Column:
    return F.regexp_extract_all(s, F.lit(OPEN + "([^" + CLOSE + "]*)" + CLOSE), 1)


def pair_counts(words_df: DataFrame) -> DataFrame:
    """Adjacent symbol pairs weighted by word frequency: ``(l, r, cnt)``."""
    syms = words_df.select(_symbols(F.col("s")).alias("y"), "freq")
    n = F.size("y") - 1
    pairs = syms.select(F.explode(F.arrays_zip(F.slice("y", 1, n).alias("l"), F.slice("y", 2, n).alias("r"))).alias("p"), "freq")
    return pairs.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("freq").cast("long").alias("cnt"))


def bpe_merges(
    texts: DataFrame,
    n_merges: int,
    *,
    checkpoint_every: int = 8,
    text_col: str = "text",
    merges_per_round: int = 1,
) -> list[tuple[int, str, str, int]]:
    """Pair-merge vocabulary (E5): ``(index, left, right, places)`` of every merge.

    ``merges_per_round = 1`` is the exact merge order, found in batches of many merges per pass
    (:func:`quire.operators.merges.train_merges`). With m > 1 a round applies up to m of the
    best pairs that share no symbol: their counts do not change each other, so each is merged
    with the count it has; the one difference from the exact order is that a pair created by a
    merge of the same round can only win from the next round on.
    """
    options.check(merges_per_round=(merges_per_round, options.COUNT))
    wc = word_counts(texts, text_col).where(~F.col("word").isin(*T.USER_DEFINED))
    if merges_per_round == 1:
        return train_merges(wc, n_merges, stored)
    return merges_by_rounds(wc, n_merges, merges_per_round, checkpoint_every)


def merges_by_rounds(wc: DataFrame, n_merges: int, merges_per_round: int, checkpoint_every: int = 8) -> list[tuple[int, str, str, int]]:
    """One job per round: all pairs counted, the best ones merged by a string replace, which joins
    non-overlapping occurrences left to right. Lineage is cut with a reliable checkpoint every few rounds."""
    wc = wc.select(symbol_string(F.col("word")).alias("s"), F.col("cnt").alias("freq"))
    # written before the first round: a round reads words and counts, never the corpus
    wc = stored(wc.where(F.length("s") > 0), "bpe-words")
    merges: list[tuple[int, str, str, int]] = []
    cur = wc
    rounds = 0
    while len(merges) < n_merges:
        want = min(merges_per_round, n_merges - len(merges))
        best = pair_counts(cur).orderBy(F.desc("cnt"), F.asc("l"), F.asc("r")).limit(4 * want).collect()
        if not best:
            break
        used: set[str] = set()
        chosen = []
        for row in best:
            left, right = row["l"], row["r"]
            if left in used or right in used:
                continue
            chosen.append((left, right, int(row["cnt"])))
            used.update((left, right))
            if len(chosen) == want:
                break
        s_col = F.col("s")
        for left, right, cnt in chosen:
            merges.append((len(merges), left, right, cnt))
            s_col = F.replace(s_col, F.lit(OPEN + left + CLOSE + OPEN + right + CLOSE), F.lit(OPEN + left + right + CLOSE))
        cur = cur.withColumn("s", s_col)
        rounds += 1
        if checkpoint_every and rounds % checkpoint_every == 0:
            cur = cur.checkpoint(eager=True)
    return merges


def bpe_piece_table(spark: SparkSession, texts: DataFrame, n_merges: int, *, coverage: float = 0.9995,
                    text_col: str = "text", vocab_size: int | None = None, merges_per_round: int = 1) -> DataFrame:
    """Pair-merge piece table (E5): the alphabet of ``▁word`` symbols, then one
    piece per merge in merge order; score = -(merge index). With
    ``vocab_size`` the table (fixed pieces included) never exceeds it."""
    options.check(merges_per_round=(merges_per_round, options.COUNT))
    # counted once: the alphabet and the merges read the written table
    words = stored(word_counts(texts, text_col).where(~F.col("word").isin(*T.USER_DEFINED)), "words")
    wc = words.select(F.concat(F.lit(T.WORD_BOUNDARY), F.col("word")).alias("w"), "cnt")
    kept = alphabet_from_counts(weighted_char_counts(wc), coverage)
    chars = [r["ch"] for r in kept.orderBy("rk").collect()]  # bounded by the code points
    if vocab_size is not None:
        room = vocab_size - T.FIRST_LEARNED_ID - len(chars)
        if room < 0:
            raise options.OptionError([f"vocab_size leaves no room for the {len(chars)} characters of the alphabet: {vocab_size}"])
        n_merges = min(n_merges, room)
    if merges_per_round == 1:
        merges = train_merges(words, n_merges, stored)
    else:
        merges = merges_by_rounds(words, n_merges, merges_per_round)
    rows, seen = [], set()
    for ch in chars:
        rows.append((ch, 0.0))
        seen.add(ch)
    for i, left, right, _ in merges:
        if left + right not in seen:
            rows.append((left + right, -float(i + 1)))
            seen.add(left + right)
    learned = spark.createDataFrame(
        [(T.FIRST_LEARNED_ID + j, p, sc) for j, (p, sc) in enumerate(rows)], "id int, piece string, score double"
    )
    return piece_table(spark, learned, F.col("score"))


# --------------------------------------------------------------------------- unigram seeds


def seed_pieces(texts: DataFrame, n_seeds: int, max_len: int = 16, text_col: str = "text") -> DataFrame:
    """Seed sub-strings of the unigram trainer over whitespace words (E6 seeds)."""
    wc = word_counts(texts, text_col).where(~F.col("word").isin(*T.USER_DEFINED))
    return seed_pieces_from_counts(wc, n_seeds, max_len)


def seed_pieces_from_counts(wc: DataFrame, n_seeds: int, max_len: int = 16) -> DataFrame:
    """Every sub-string of a distinct word up to ``max_len`` characters, counted with the word's
    frequency. Kept: the ``n_seeds`` best by frequency x length (then piece). ``wc``: ``(word, cnt)``.

    Sub-strings come as intervals of sorted suffixes (:mod:`quire.operators.suffixes`); those of an
    interval are spelt out only where the longest of them can be among the best.
    """
    found = stored(S.intervals(wc, max_len), "intervals")
    longest = found.select((F.col("freq") * F.length("text")).alias("score"))
    n = longest.count()
    if n > n_seeds:  # the n best of the longest ones bound the n best of all from below
        error = 0.001
        bound = longest.approxQuantile("score", [max(0.0, 1.0 - n_seeds / n - 2 * error)], error)[0]
        found = found.where(F.col("freq") * F.length("text") >= F.lit(bound).cast("long"))
    scored = stored(S.spelt(found).withColumn("score", F.col("freq") * F.length("piece")), "seeds")
    return O.top_n(scored, n_seeds, "score", [F.asc("piece")]).drop("rk")


def learn_word_pieces(spark: SparkSession, texts: DataFrame, vocab_size: int, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Word vocabulary and full piece table, counted once.

    The word counts are written once for the passes of the exact top-n (the
    score histogram and the cut); the learned table itself is bounded by
    ``vocab_size`` and comes back as a small local frame, so every later
    broadcast is cheap and the corpus is not re-counted per use.
    Returns ``(vocab(id, word, piece, cnt), pieces(id, piece, score, type))``.
    """
    counts = stored(word_counts(texts, text_col), "words")
    total = counts.agg(F.sum("cnt")).first()[0] or 0
    learned = O.top_n(counts.where(~F.col("word").isin(*T.USER_DEFINED)), vocab_size, "cnt", [F.asc("word")])
    rows = learned.select("rk", "word", "cnt").collect()
    if len(rows) > vocab_size:
        raise ValueError("learned vocabulary exceeds its bound")
    vocab_rows = [(T.FIRST_LEARNED_ID - 1 + r["rk"], r["word"], T.WORD_BOUNDARY + r["word"], int(r["cnt"])) for r in rows]
    vocab = spark.createDataFrame(vocab_rows, "id int, word string, piece string, cnt long")
    learned_pieces = spark.createDataFrame(
        [(i, p, math.log(c / total), "NORMAL") for i, _, p, c in vocab_rows], PIECE_SCHEMA
    )
    return vocab, special_and_byte_pieces(spark).unionByName(learned_pieces)


def train_vocabulary(
    spark: SparkSession,
    corpus_path: str,
    vocab_size: int = 12_000,
    *,
    model_type: str = "unigram",
    character_coverage: float = 0.9995,
    normalization_rule_name: str = "nmt_nfkc",
    normalization_rule_tsv: str | None = None,
    merges: int | None = None,
    merges_per_round: int = 1,
    max_line_bytes: int = T.MAX_SENTENCE_BYTES,
) -> DataFrame:
    """Train a piece table from a corpus folder of text lines.

    Checks the arguments and that the corpus exists, normalises the lines by
    the named rule (plus an optional rule file), then runs the word, char,
    pair-merge or unigram trainer. Returns ``(id, piece, score, type)`` with
    the fixed specials and bytes first."""
    from py4j.protocol import Py4JJavaError
    from pyspark.sql.utils import AnalysisException

    from quire.operators import clean as B
    from quire.operators import unigram as U

    TrainingOptions(vocab_size, character_coverage, model_type, normalization_rule_name)
    try:
        lines = spark.read.text(corpus_path).withColumnRenamed("value", "text")
    except (AnalysisException, Py4JJavaError) as exc:
        raise FileNotFoundError(f"corpus not found: {corpus_path}") from exc
    rules = B.read_rules_tsv(spark, normalization_rule_tsv) if normalization_rule_tsv else []
    # normalised text keeps spaces (not the boundary marker): the trainers split on them
    lines, skipped = B.trainer_lines(lines, max_line_bytes, "text")
    left_out = skipped.first()
    if left_out["skipped_lines"]:
        logging.getLogger(__name__).warning("%d lines over %d bytes (%d bytes) do not train", left_out["skipped_lines"], max_line_bytes, left_out["skipped_bytes"])
    normed = lines.select(B.normalise_by_rule(F.col("text"), normalization_rule_name, rules).alias("t"))
    texts = normed.select(F.replace(F.col("t"), F.lit(T.WORD_BOUNDARY), F.lit(" ")).alias("text"))
    learned_size = vocab_size - FIRST_ID
    options.check(vocab_size=(vocab_size, options.at_least(FIRST_ID + 1)))  # the fixed pieces come first
    if model_type == "word":
        return word_piece_table(spark, texts, learned_size)
    if model_type == "char":
        cv = char_vocabulary(texts, character_coverage)
        return piece_table(spark, cv.where(F.col("id") < vocab_size), F.col("score"))
    if model_type == "bpe":
        n = merges if merges is not None else learned_size
        return bpe_piece_table(spark, texts, n, coverage=character_coverage, vocab_size=vocab_size,
                               merges_per_round=merges_per_round)
    learned = U.train_unigram(spark, texts, learned_size, coverage=character_coverage)
    return U.unigram_piece_table(spark, learned)
