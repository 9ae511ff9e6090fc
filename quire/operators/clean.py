"""Text clean-up (B2–B5): usable rows, sentence lines, normalisation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quire import options
from quire.functions import text as T

# The rule names, and what the nmt rule drops or makes a blank.
NMT_DROPPED = "[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F\\x8F\\x9F]"
NMT_SPACES = "[\\t\\n\\r\\x0C\\u1680\\u2000-\\u200F\\u2028\\u2029\\u205F\\u2581\\u3000\\uFEFF\\uFFFD]"
NATIVE_RULES = 32  # tables up to here are rewritten by column functions
NORMALIZATION_RULES = ("nmt_nfkc", "nfkc", "nfkc_cf", "identity")


def usable(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Rows that give at least one token (B2); NULL text never reaches the encoder."""
    return encoded.where(F.size(ids_col) > 0)


def sentence_lines(df: DataFrame, terminators=(T.SENTENCE_TERMINATOR,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Corpus lines (B3): break after terminators, split on newlines, keep every
    non-empty line whatever its length. ``line_no`` counts all lines."""
    broken = T.sentence_break(F.col(text_col), terminators)
    lines = df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(broken, "\n")).alias("line_no", "line"))
    return lines.where(F.col("line") != "")


def trainer_lines(lines: DataFrame, max_bytes: int = T.MAX_SENTENCE_BYTES, line_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """What the vocabulary trainer reads (B4), and what it leaves out.

    The trainer passes over lines of more than ``max_bytes`` UTF-8 bytes; nothing else does.
    The second frame has one row, ``(skipped_lines, skipped_bytes)``, so that a run can say so.
    """
    size = F.octet_length(line_col)
    skipped = lines.where(size > max_bytes).agg(F.count("*").alias("skipped_lines"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("skipped_bytes"))
    return lines.where(size <= max_bytes), skipped


def normalise(text: Column, rules=T.CUSTOM_RULES, dummy_prefix: bool = True, escape: bool = True) -> Column:
    """Rules in one pass, extra-whitespace removal, whitespace escape and dummy prefix."""
    rules = list(rules)
    done = T.apply_rules(text, rules) if len(rules) <= NATIVE_RULES else rewrite("identity", rules)(text)
    return _spaced(done, dummy_prefix, escape)


def _spaced(text: Column, dummy_prefix: bool = True, escape: bool = True) -> Column:
    out = T.collapse_whitespace(text)
    return T.escape_whitespace(out, dummy_prefix) if escape else out


def _nfkc(s: pd.Series, casefold: bool) -> pd.Series:
    def one(x):
        if x is None:
            return None
        y = unicodedata.normalize("NFKC", x)
        return y.casefold() if casefold else y

    return s.map(one)


@pandas_udf(StringType())
def nfkc_udf(s: pd.Series) -> pd.Series:
    """NFKC over an Arrow batch (Spark has no built-in NFKC)."""
    return _nfkc(s, False)


def named_rule(name: str) -> Callable[[str], str]:
    """What a named rule does to a piece of text that no rule of the table matches."""
    if name == "identity":
        return lambda x: x
    if name == "nfkc_cf":
        return lambda x: unicodedata.normalize("NFKC", x).casefold()
    if name == "nfkc":
        return lambda x: unicodedata.normalize("NFKC", x)
    dropped, spaces = re.compile(NMT_DROPPED), re.compile(NMT_SPACES)
    return lambda x: spaces.sub(" ", dropped.sub("", unicodedata.normalize("NFKC", x)))


def rewritten(text: str, pattern: re.Pattern | None, table: dict[str, str], other: Callable[[str], str]) -> str:
    """One pass: where the table's automaton matches, the target; the stretches between by the named rule."""
    if pattern is None:
        return other(text)
    out, at = [], 0
    for m in pattern.finditer(text):
        out += [other(text[at : m.start()]), table[m[0]]]
        at = m.end()
    return "".join([*out, other(text[at:])])


def rewrite(rule_name: str, rules) -> Callable[[Column], Column]:
    """An Arrow function that applies the rule table and the named rule in one pass: the longest source
    at the leftmost place, and neither rewrites what the other has made. Any number of rules."""
    table = T.rule_table(rules)
    pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), T.prefix_pattern(table)) if table else None

    @pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled, other = pattern and re.compile(pattern), named_rule(rule_name)
        for s in batches:
            yield s.map(lambda x: None if x is None else rewritten(x, compiled, table, other))

    return run


def normalise_by_rule(text: Column, rule_name: str = "nmt_nfkc", rules=()) -> Column:
    """Named normalisation: identity, nfkc, nfkc_cf or nmt_nfkc (NFKC, then control and
    zero-width characters dropped and the remaining separators made blanks), in one pass with the
    rule table, then the whitespace steps."""
    options.check(normalization_rule=(rule_name, options.one_of(NORMALIZATION_RULES)))
    if rule_name == "identity":
        return normalise(text, rules)
    return _spaced(rewrite(rule_name, rules)(text))


def read_rules_tsv(spark, path: str) -> list[tuple[str, str]]:
    """A custom normalisation table (source TAB target per line), in file order.

    The table is a small configuration file (bounded), read with Spark so any
    shared file system works; a missing file is an error."""
    from pyspark.sql.utils import AnalysisException

    try:
        df = spark.read.option("sep", "\t").option("quote", "").csv(path)
    except AnalysisException as exc:
        raise FileNotFoundError(f"normalization rule file not found: {path}") from exc
    rows = df.withColumn("__i", F.monotonically_increasing_id()).orderBy("__i").collect()
    return [(r[0], r[1] or "") for r in rows if r[0] is not None]
