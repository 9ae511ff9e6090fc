"""Encoding, decoding, templates and chat (B6, B7, F1–F8) for piece tables.

Word encoding and decoding look pieces up inside the row: the piece table, whose size is
bounded by the vocabulary size and checked, is a broadcast variable; the distinct words of
an Arrow batch are looked up once and their ids dealt back to the rows by array
operations. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import options
from quire.functions import text as T
from quire.session import small_batches

MAX_BROADCAST_PIECES = 5_000_000
AT_ONCE = 1 << 18  # words or ids that array operations work on at once


def _held(rows: DataFrame, bound: int) -> list:
    """The rows of a piece table on the driver, for a broadcast; their number is checked."""
    if bound > MAX_BROADCAST_PIECES:
        raise ValueError(f"a piece table of up to {bound} rows is over the broadcast limit of {MAX_BROADCAST_PIECES}")
    got = rows.limit(bound + 1).collect()
    if len(got) > bound:
        raise ValueError(f"the piece table has more than the {bound} rows its caller promised")
    return got


def spread_pieces(codes: np.ndarray, pieces: list, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``pieces[code]`` for every code, one after another, and how many each code gives."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.fromiter((x for p in pieces for x in p), dtype, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    n = sizes[codes]
    before = np.cumsum(n) - n
    at = np.repeat(first[codes] - before, n) + np.arange(int(n.sum()))
    return flat[at], n


def row_sums(n: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``n`` over the rows that ``offsets`` bounds, cumulated: the new offsets."""
    return np.concatenate([[0], np.cumsum(n)])[offsets - offsets[0]]


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` (AT_ONCE) elements of a list column; a longer row stands alone.

    Spark bounds a batch by rows, so arrays over a whole batch would grow with the length of the texts.
    """
    most = most or AT_ONCE
    for b in batches:
        ends, i = np.asarray(b.column(column).offsets, np.int64), 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def map_words(df: DataFrame, keep: tuple[str, ...], words: Column, pieces_of: Callable[[], Callable[[str], list[int]]]) -> DataFrame:
    """``*keep, ids`` where ids are the pieces of every word of the row; rows without pieces are left out (B2).

    ``pieces_of`` makes, once per task, the function word -> ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = pieces_of()
        for b in bounded(batches, len(keep)):
            lists = b.column(len(keep))
            coded = lists.flatten().dictionary_encode()
            pieces = [find(w) for w in coded.dictionary.to_pylist()]
            ids, n = spread_pieces(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pieces, np.int32)
            ends = row_sums(n, np.asarray(lists.offsets))
            made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            out = pa.RecordBatch.from_arrays([*b.columns[: len(keep)], made], names=[*keep, "ids"])
            yield out.filter(pa.array(np.diff(ends) > 0))

    small_batches(df.sparkSession)
    src = df.select(*keep, words.alias("__w")).where(F.size("__w") > 0)
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{schema}, ids array<int>")


def encode_words(
    df: DataFrame,
    vocab: DataFrame,
    vocab_bound: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Word-model encode without special tokens (F1, F2).

    ``vocab`` has ``(word, id)``. Known words map to one id, user-defined
    symbols to their own id, any other word to one byte piece per UTF-8 byte
    of ``▁word``. Rows whose text is NULL or gives no words are dropped (B2).
    Output: ``id_col, *keep, ids array<int>``.
    """
    table = {r["word"]: [r["id"]] for r in _held(vocab.select("word", "id"), vocab_bound)}
    table |= {piece: [i] for i, piece, _ in T.SPECIAL_PIECES if piece in T.USER_DEFINED}
    held = df.sparkSession.sparkContext.broadcast(table)

    def pieces_of() -> Callable[[str], list[int]]:
        known = held.value

        def find(word: str) -> list[int]:
            if (ids := known.get(word)) is not None:
                return ids
            return [T.BYTE_BASE + b for b in (T.WORD_BOUNDARY + word).encode("utf-8", "replace")]

        return find

    return map_words(df, (id_col, *keep), T.words(F.col(text_col)), pieces_of)


def decode_ids(
    df: DataFrame,
    pieces: DataFrame,
    pieces_bound: int,
    *,
    id_col: str = "doc_id",
    ids_col: str = "ids",
    skip_special: bool = True,
) -> DataFrame:
    """ids -> text (F6). Pieces become UTF-8 bytes (byte pieces give their byte), ``▁`` turns
    into a space and the leading dummy-prefix space is removed. Bytes that are no UTF-8, such
    as a character cut by a truncation, become U+FFFD. Unknown ids give nothing; a row whose
    ids are all special, or that has none, gives the empty text."""
    table: dict[int, bytes] = {}
    for r in _held(pieces.select("id", "piece", "type"), pieces_bound):
        table[r["id"]] = bytes([int(r["piece"][3:5], 16)]) if r["type"] == "BYTE" else r["piece"].encode()
    if skip_special:
        table |= dict.fromkeys(T.SKIP_ON_DECODE, b"")
    held = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in bounded(batches, 1):
            lists = b.column(1)
            coded = lists.flatten().dictionary_encode()
            raw, n = spread_pieces(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                                   [known.get(i, b"") for i in coded.dictionary.to_pylist()], np.uint8)
            ends = row_sums(n, np.asarray(lists.offsets))
            data = raw.tobytes()
            texts = [data[i:j].decode("utf-8", "replace").replace(T.WORD_BOUNDARY, " ") for i, j in zip(ends, ends[1:])]
            texts = [t[1:] if t.startswith(" ") else t for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    small_batches(df.sparkSession)
    src = df.select(id_col, F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda x: x.isNotNull()).alias("__i"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, text string")


def template_single(ids: Column, bos: int = T.BOS_ID, eos: int = T.EOS_ID) -> Column:
    """``<s> $A </s>``."""
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def template_pair(a: Column, b: Column, bos: int = T.BOS_ID, eos: int = T.EOS_ID) -> tuple[Column, Column]:
    """``<s> $A </s> $B:1 </s>:1`` (F4): ids and type ids."""
    ids = F.concat(F.array(F.lit(bos)), a, F.array(F.lit(eos)), b, F.array(F.lit(eos)))
    types = F.concat(F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(b) + 1))
    return ids, types


def truncate_single(ids: Column, max_length: int) -> Column:
    """Truncation to ``max_length`` including the two specials, then F3."""
    options.check(max_length=(max_length, options.at_least(2)))  # two specials
    return template_single(F.slice(ids, 1, max_length - 2))


def prompt_frame(ids: Column, eos: int = T.EOS_ID) -> Column:
    """EOS + prompt ids."""
    return F.concat(F.array(F.lit(eos)), ids)


def crop_last(ids: Column, n: int) -> Column:
    """Keep the last ``n`` tokens."""
    return F.slice(ids, F.greatest(F.size(ids) - F.lit(n) + F.lit(1), F.lit(1)), n)


def render_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Chat template (F8): ``<|im_start|>{role}\\n{content}<|im_end|>\\n`` per
    message in turn order, no generation prompt, no BOS.

    One conversation is one training sample, so its messages form a bounded
    group; the ordered ``listagg`` runs after a map-side partial aggregate.
    """
    msg = F.concat(F.lit(T.CHAT_OPEN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(T.CHAT_CLOSE + "\n"))
    return (
        messages.select(conv_col, turn_col, msg.alias("m"))
        .groupBy(conv_col)
        .agg(F.expr(f"listagg(m, '') WITHIN GROUP (ORDER BY {turn_col})").alias("chat"))
    )
