"""The rows that the corpus caps keep are sent to the texts; the texts are not shuffled for them."""

import random

from quire.sources import registry as R
from quire.sources import sinks as K


def test_texts_are_not_shuffled_for_few_rows(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, "".join(draw.choices("abcdefghij klmnop.", k=4000))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    reg = R.SourceRegistry([R.SourceSpec(genre="one", path=str(tmp_path / "docs"))])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        lines = K.corpus_lines(spark, reg, {"one": 1.0}, max_documents=7, terminators=(".",))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        got = lines.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.pos for r in got) == list(range(7)) and "SortMergeJoin" not in plan, plan
