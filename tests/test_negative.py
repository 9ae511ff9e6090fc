"""One test per argument check (FIXTURES.md §5)."""

import pytest
from pyspark.sql import functions as F

from quire.operators import candidates as I
from quire.operators import encode as E
from quire.operators import mix as M
from quire.operators import order as D
from quire.operators import pack as G
from quire.operators import vocab as V
from quire.sources import registry as R
from quire.sources import sinks as K

REG = R.documents_registry("/root/testdata/sf0.001")


@pytest.mark.parametrize(
    "mix",
    [{}, {"novel": 1.0}, {"wiki": 0.0, "web": 1.0}, {"wiki": 0.5, "web": 0.49}],
)
def test_bad_mix(mix):
    with pytest.raises(ValueError):
        M.Choice.of(REG, mix)


def test_bad_strategy_preset_type_split(spark):
    with pytest.raises(ValueError):
        M.mixed(spark, REG, {"wiki": 1.0}, strategy="sometimes")
    with pytest.raises(ValueError):
        M.recommended_mix("huge")
    with pytest.raises(TypeError):
        M.mixed(spark, REG, 42, strategy="all_exhausted")
    with pytest.raises(ValueError):
        M.mixed(spark, REG, "wiki", split="dev", strategy="all_exhausted")
    with pytest.raises(ValueError):
        R.read_source(spark, REG, "wiki", "validation")  # not offered
    with pytest.raises(ValueError):
        M.mixed(spark, REG, "novel", strategy="all_exhausted")


def test_bad_buffer_and_limits(spark):
    df = spark.range(3).withColumnRenamed("id", "pos")
    with pytest.raises(ValueError):
        D.buffered_shuffle(df.withColumn("doc_id", F.col("pos")), 42, 0)
    with pytest.raises(ValueError):
        D.per_shard_limit(df.withColumn("shard", F.lit(0)), 0)
    with pytest.raises(ValueError):
        D.corpus_row_cap(df, 0)
    with pytest.raises(ValueError):
        G.batches(df, 0)
    with pytest.raises(ValueError):
        G.cut_blocks(df, 0)
    with pytest.raises(ValueError):
        K.corpus_lines(spark, REG, max_documents=0)
    with pytest.raises(ValueError):
        K.corpus_lines(spark, REG, max_bytes=0)


def test_bad_training_args():
    with pytest.raises(ValueError):
        V.TrainingOptions(99)
    with pytest.raises(ValueError):
        V.TrainingOptions(1000, character_coverage=0.0)
    with pytest.raises(ValueError):
        V.TrainingOptions(1000, character_coverage=1.5)
    with pytest.raises(ValueError):
        V.TrainingOptions(1000, model_type="wordpiece")
    with pytest.raises(ValueError):
        V.TrainingOptions(1000, normalization_rule_name="  ")


def test_bad_penalty_and_pad(spark):
    with pytest.raises(ValueError):
        I.check_penalty(0.9)
    pieces = spark.createDataFrame([(9, "x", 0.0, "NORMAL")], "id int, piece string, score double, type string")
    with pytest.raises(Exception, match="no <pad>"):
        V.pad_choice(pieces).collect()
    for ids, want in ((["<unk>", "</s>", "<pad>"], 2), (["<unk>", "</s>"], 1), (["<unk>"], 0)):
        table = spark.createDataFrame([(i, p, 0.0, "CONTROL") for i, p in enumerate(ids)], "id int, piece string, score double, type string")
        assert V.pad_choice(table).first().pad_id == want
    with pytest.raises(ValueError):
        E.truncate_single(F.col("ids"), 1)


def test_all_problems_are_told_at_once():
    from quire.options import OptionError

    with pytest.raises(OptionError) as e:
        V.TrainingOptions(1, 2.0, "x", " ")
    assert len(e.value.problems) == 4
    with pytest.raises(OptionError) as e:
        M.Choice.of(REG, {"novel": 0.0, "wiki": 0.5}, "dev", "sometimes")
    assert len(e.value.problems) == 5  # split, genre, strategy, weight, sum
