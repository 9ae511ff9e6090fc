"""Array operations of the encoders see a bounded number of words, however many a batch of rows holds."""

import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import encode as E


def test_slices_hold_at_most_the_given_number_of_elements():
    rows = [[1, 2], [], [3, 4, 5, 6, 7], [8], [], [9, 10], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(rows)], names=["id", "x"]).slice(1)
    got = list(E.bounded(iter([batch, batch.slice(0, 0)]), 1, 3))
    assert [r for b in got for r in b.column(1).to_pylist()] == rows[1:]
    assert [i for b in got for i in b.column(0).to_pylist()] == [1, 2, 3, 4, 5, 6]
    assert all(len(b.column(1).flatten()) <= 3 or b.num_rows == 1 for b in got)


def test_slices_lose_no_word(spark):
    n = E.AT_ONCE // 3
    docs = spark.range(8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w1 w2 zz "), F.lit(n // 3).cast("int") - F.col("id").cast("int")).alias("text")).coalesce(1)
    vocab = spark.createDataFrame([("w1", 301), ("w2", 302)], "word string, id int")
    got = {r.doc_id: (r.n, r.m) for r in E.encode_words(docs, vocab, 2).select("doc_id", F.size("ids").alias("n"), F.size(F.array_distinct("ids")).alias("m")).collect()}
    # zz is no piece: the bytes of the word boundary (three) and of two letters
    assert got == {i: (7 * (n // 3 - i), 2 + len(set("▁zz".encode()))) for i in range(8)}
