"""Rows reach the encoders' workers in small Arrow batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import encode as E
from quire.session import ARROW_BYTES, small_batches


def _largest(spark):
    def size(batches):
        yield pa.RecordBatch.from_pydict({"n": [max((b.nbytes for b in batches), default=0)]})

    rows = spark.range(4000).coalesce(1).select(F.repeat(F.lit("word "), 800).alias("text"))
    return max(r.n for r in rows.mapInArrow(size, "n long").collect())


def test_an_encoder_sets_the_limit_of_batches(spark):
    was = spark.conf.get(ARROW_BYTES, None)
    try:
        spark.conf.unset(ARROW_BYTES)
        docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
        E.map_words(docs, ("doc_id",), T.words(F.col("text")), lambda: lambda w: [1])
        assert _largest(spark) < 5 << 20
        spark.conf.set(ARROW_BYTES, "1m")
        small_batches(spark)  # the session's own limit stays
        assert spark.conf.get(ARROW_BYTES) == "1m"
        assert _largest(spark) < 2 << 20
    finally:
        spark.conf.unset(ARROW_BYTES) if was is None else spark.conf.set(ARROW_BYTES, was)
