"""Sub-strings of words by sorted suffixes (E6 seeds): a suffix array in ranges, with its common-prefix intervals.

All sub-strings of a word are prefixes of its suffixes. The suffixes of the distinct words (cut
to ``max_len`` characters, equal ones summed) are sorted over range partitions; going through a
range, neighbours that share a prefix form an interval, and all sub-strings that end inside one
interval's edge have the same places. So one row (longest text, shortest length, places) stands
for a run of sub-strings, and no sub-string is spelt out where it occurs.

A range's first and last suffixes may share prefixes with the next range. Only those sub-strings
are spelt out and summed over ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_suffixes(wc: DataFrame, max_len: int) -> DataFrame:
    """(suffix, cnt), sorted within ranges. ``wc``: word, cnt."""
    starts = wc.select("word", F.col("cnt").cast("long").alias("cnt"), F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    cut = starts.select(F.substring(F.col("word"), F.col("at"), F.lit(max_len)).alias("suffix"), "cnt").where(F.length("suffix") > 0)
    return cut.groupBy("suffix").agg(F.sum("cnt").alias("cnt")).repartitionByRange("suffix").sortWithinPartitions("suffix")


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def _closed(suffixes: Iterator[tuple[str, int]]) -> Iterator[tuple[str, int, int, bool]]:
    """(longest text, shortest length, places, edge) of the intervals of sorted suffixes with their counts.

    ``edge``: the text's prefixes are prefixes of the first or the last suffix too.
    """
    first, now, own = None, "", [0]

    def close(upto: int, last: bool) -> Iterator[tuple[str, int, int, bool]]:
        """The prefixes of ``now`` longer than ``upto``, longest first, as runs of equal places."""
        places, top = 0, len(now)
        for d in range(len(now), upto, -1):
            if own[d] and d < len(now):
                if places:
                    yield from row(top, d + 1, places, last)
                top = d
            places += own[d]
        if places:
            yield from row(top, upto + 1, places, last)
        own[upto] += places
        del own[upto + 1 :]

    def row(top: int, low: int, places: int, last: bool) -> Iterator[tuple[str, int, int, bool]]:
        shared = top if last else _common(now[:top], first)
        if shared >= low:  # the shorter ones are prefixes of the first (or last) suffix
            yield now[:shared], low, places, True
        if shared < top:
            yield now[:top], max(low, shared + 1), places, False

    for suffix, n in suffixes:
        if first is None:
            first = suffix
        else:
            yield from close(_common(now, suffix), False)
        now = suffix
        own += [0] * (len(now) + 1 - len(own))
        own[len(now)] += n
    if first is not None:
        yield from close(0, True)


def spelt(found: DataFrame) -> DataFrame:
    """(piece, freq) of every sub-string of the intervals (text, low, freq)."""
    lengths = F.explode(F.sequence(F.col("low"), F.length("text"))).alias("n")
    return found.select("text", "freq", lengths).select(F.left("text", F.col("n")).alias("piece"), "freq")


def intervals(wc: DataFrame, max_len: int) -> DataFrame:
    """(text, low, freq, edge): each sub-string of ``text`` from its start, of ``low`` or more characters, has ``freq`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, int]]:
            for b in batches:
                yield from zip(b.column("suffix").to_pylist(), b.column("cnt").to_pylist())

        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.bool_())
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["text", "low", "freq", "edge"])
            out.clear()
            return batch

        for row in _closed(rows()):
            out.append(row)
            if len(out) >= 50_000:
                yield made()
        yield made()

    found = sorted_suffixes(wc, max_len).mapInArrow(run, "text string, low int, freq long, edge boolean")
    # the same sub-string at the end of one range and the start of the next, wherever ranges are long or short
    edges = spelt(found.where("edge")).groupBy("piece").agg(F.sum("freq").alias("freq"))
    edges = edges.select(F.col("piece").alias("text"), F.length("piece").alias("low"), "freq", F.lit(True).alias("edge"))
    return found.where("not edge").unionByName(edges)


def repeats(found: DataFrame) -> DataFrame:
    """(piece, freq): the longest sub-string of every interval of two places or more, two characters or more.

    These are the sub-strings that no further character always follows (words' ends count as one).
    Those that were spelt out at the ends of ranges are compared with what continues them.
    """
    inner = found.where("not edge").select(F.col("text").alias("piece"), "freq")
    edges = found.where("edge").select(F.col("text").alias("piece"), "freq")
    longer = found.select(F.expr("left(text, low - 1)").alias("piece"), F.col("freq").alias("more"))
    longer = longer.join(edges.select("piece"), "piece", "left_semi").groupBy("piece").agg(F.max("more").alias("more"))
    open_ = edges.join(longer, "piece", "left").where(F.coalesce("more", F.lit(0)) < F.col("freq")).select("piece", "freq")
    return inner.unionByName(open_).where((F.col("freq") > 1) & (F.length("piece") > 1))
