"""Id arrays become text without a lambda per id."""

from pyspark.sql import functions as F

from quire.functions import text as T


def test_text_of_ids_has_no_lambda(spark):
    rows = [([1, -100, 3],), ([],), (None,), ([None, 5, None],), ([None],)]
    df = spark.createDataFrame(rows, "a array<int>").select(T.ids_text(F.col("a")).alias("t"))
    assert [r.t for r in df.collect()] == ["1 -100 3", "", None, "5", ""]
    assert "lambda" not in df._jdf.queryExecution().analyzed().toString()
