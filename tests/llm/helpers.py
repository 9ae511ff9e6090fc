"""Fixtures and brute-force versions for the training-data operators."""

from __future__ import annotations

import random
import re
import zlib

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOW = str.maketrans(UPPER, UPPER.lower())
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside: they must not clash with a caller's columns
EXTRA = ["copies", "bucket", "shard", "slot", "size", "record", "fp", "root", "node", "key", "t1", "h1", "site_hash", "rejected", "n_lines"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and to in river stone light answer Wind élan über 42 cloud garden paper".split()) for _ in range(n))


def awkward_rows(seed: int = 3) -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows and ids."""
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randint(1, 60)), "en", f"src{i % 4}", 10) for i in range(60)]
    long = sentence(rng, 30_000)
    rows += [(100, long, "en", "src0", None), (101, long + " end", None, "src1", 1), (102, None, None, None, None), (None, "text without id", "en", "src1", 3),
             (None, None, None, None, None), (103, "", "de", "src2", 0), (104, " \t\n\r\x0b\x0c ", "de", "src2", 6), (105, "Ünïcode und mehr 文字", "de", None, 9)]
    rows += [rows[5]] * 7 + [(5, "another text of id five", "en", "src3", 4)] * 2 + [(200 + i, rows[7][1], "en", f"src{i % 3}", 2) for i in range(40)]
    rows += [(300, "one two", "en", "src2", 1), (301, "one two", "en", "src2", 1), (302, "word", "en", "z", 1)]
    return rows


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])
    return df


def space_words(text):
    return SPACE_WORDS.findall((text or "").translate(LOW))


def crc_mod(doc_id, m):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
