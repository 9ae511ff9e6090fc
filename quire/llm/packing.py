"""Operator 11, best-fit packing of whole documents into sequences by sums of squares.

Every text becomes its token ids and one end id. Only documents longer than a sequence are
cut, into whole sequences and one shorter last piece. The pieces are dealt over groups of
about ``PIECES_PER_GROUP`` by a hash of their row in the written table, so groups are of like
size whatever the sources or copies, and each group is packed by itself in one task.

Within a group pieces go longest first. With N(g) the number of open sequences that have g
free places, a piece of s ids goes where the sum over g of N(g)^2 becomes smallest: taking an
open sequence of g places changes it by 2 (N(g - s) - N(g)) + 2, or by 1 - 2 N(s) where it
becomes full. Ties go to the smallest g. A new sequence is opened only where none has room.
Only the counts per gap are looked at, so a placement costs the same at any number of open
sequences. A group wastes less than one sequence or so.

Null and empty texts are the end id alone. Repeated rows and repeated ids are documents of
their own. An empty table gives no rows. Columns beside the id and the text are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.common import LOWER_ASCII, materialise, text_bytes, unused
from quire.llm.words import groups

CAPACITY = 4096
END_ID = 1
PIECES_PER_GROUP = 20_000
KNOWN_WORDS = 1_000_000  # words whose ids a Python worker keeps
WORDS_AT_ONCE, STRINGS_AT_ONCE = 256, 64
# between an ASCII letter or digit and a mark; what stands before may be a letter of another script, so not there
_BEFORE_MARK = re.compile(rb"(?<=[a-z0-9])(?=[!-/:-@\[-`{-~])")

_ENCODERS: dict = {}


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes, by way of the ids of their words.

    For tokenizers that lower-case, drop white space and never join across it, nor across the
    place between a letter or digit and a mark: a text's ids are those of its parts, one after
    another. Strings of special tokens are ordinary text. A worker remembers the parts it knows.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def of(path: str) -> WordEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        return _ENCODERS[path]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [_BEFORE_MARK.sub(b" ", t.translate(LOWER_ASCII)).split() for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = list(set().union(*words).difference(self.known))
        for k in range(0, len(new), WORDS_AT_ONCE * STRINGS_AT_ONCE):
            self._learn(new[k : k + WORDS_AT_ONCE * STRINGS_AT_ONCE])
        return [b"".join(map(self.known.__getitem__, w)) for w in words]

    def _learn(self, words: list[bytes]) -> None:
        """Encode words by the hundred as one text: a token belongs to the word it begins in."""
        runs = [words[k : k + WORDS_AT_ONCE] for k in range(0, len(words), WORDS_AT_ONCE)]
        texts = [[w.decode() for w in r] for r in runs]
        found = self.tokenizer.encode_batch([" ".join(t) for t in texts], add_special_tokens=False)
        for run, text, e in zip(runs, texts, found):
            starts = np.cumsum([0, *[len(w) + 1 for w in text]])
            begin = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            cuts = (4 * np.searchsorted(begin, starts)).tolist()
            raw = np.asarray(e.ids, "<u4").tobytes()
            self.known.update(zip(run, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))


def encode_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (little-endian unsigned 32-bit, as bytes)."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_bytes(F.col(text_col)).alias("t"))
    end = np.asarray([end_id], "<u4").tobytes()
    out = StructType([source.schema["doc_id"], *StructType.fromDDL("piece int, start long, length long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer_path)
        for batch in batches:
            at = 0
            for texts in groups(batch.column("t").to_pylist()):
                ids = [x + end for x in encoder.encode(texts)]
                cuts = [(k, p, x[p : p + 4 * capacity]) for k, x in enumerate(ids) for p in range(0, len(x), 4 * capacity)]
                row = pa.array([at + k for k, _, _ in cuts], pa.int64())
                begin = np.asarray([p // 4 for _, p, _ in cuts], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), pa.array((begin // capacity).astype(np.int32)), pa.array(begin),
                     pa.array(np.asarray([len(x) // 4 for *_, x in cuts], np.int64)), pa.array([x for *_, x in cuts], pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )
                at += len(texts)

    return source.mapInArrow(run, out)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece, placed in the given order; lengths are 1 to ``capacity``."""
    count = np.zeros(capacity + 1, np.int64)  # N(g); g = 0 and g = capacity are never counted
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[s:])  # less s: what is left after the piece
        if len(gaps):
            change = 2 * (count[gaps] - count[gaps + s]) + 2
            if gaps[0] == 0:
                change[0] = 1 - 2 * count[s]
            left = int(gaps[change.argmin()])
            at = open_[left + s].pop()
            count[left + s] -= 1
        else:
            left, at, made = capacity - s, made, made + 1
        where[k], offset[k] = at, capacity - left - s
        if left:
            open_[left].append(at)
            count[left] += 1
    return where, offset


def place(pieces: DataFrame, row: str, length: str, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``row`` is unique and fixed (read from a written table); it decides ties."""
    n = max(1, -(-pieces.count() // PIECES_PER_GROUP))
    key = unused("pack_group", pieces.columns)
    dealt = pieces.withColumn(key, F.pmod(F.xxhash64(row), F.lit(n)))
    out = StructType([*pieces.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    names = pieces.columns

    def pack(group: pa.Table) -> pa.Table:
        number = group.column(key)[0].as_py()
        group = group.sort_by([(length, "descending"), (row, "ascending")])
        where, offset = sum_of_squares(group.column(length).to_numpy(), capacity)
        return group.select(names).append_column("sequence_id", pa.array(where + (number << 32))).append_column("offset", pa.array(offset))

    return dealt.groupBy(key).applyInArrow(pack, out)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(pieces, places): the written pieces with their ids and a ``row``, and ``row, sequence_id, offset``."""
    pieces = encode_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    pieces = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pieces, place(pieces.select("row", "length"), "row", "length", capacity).drop("length")


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed sequences themselves, each at most ``capacity`` ids."""
    part = F.struct("offset", "ids")
    both = pieces.select("row", "ids").join(places, "row")
    bound = both.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return bound.select("sequence_id", (F.octet_length(ids) / 4).cast("long").alias("length"), ids.alias("ids"))


def piece_digests(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids and their place; ids stay where they are."""
    return pieces.select("row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")).join(places, "row").drop("row")
