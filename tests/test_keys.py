"""Sources whose rows have a key of another type, or none."""

from quire.operators import mix as M
from quire.sources import registry as R
from tests.conftest import SF_SMALL


def _registry(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.select("text").limit(60).repartition(3).write.parquet(f"{tmp_path}/bare")
    docs.selectExpr("concat('k', doc_id) as name", "text").limit(50).write.json(f"{tmp_path}/named")
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text("one\ntwo\none\n", encoding="utf-8")
    return R.SourceRegistry([
        R.SourceSpec("bare", f"{tmp_path}/bare", id_column=None),
        R.SourceSpec("named", f"{tmp_path}/named", format="json", id_column="name"),
        R.SourceSpec("lines", f"{tmp_path}/lines", format="text", text_column="value", id_column=None),
    ])


def test_rows_without_a_number_get_stable_keys(spark, tmp_path):
    reg = _registry(spark, tmp_path)
    for genre, n in (("bare", 60), ("named", 50), ("lines", 3)):
        df = R.read_source(spark, reg, genre)
        ids = [r.doc_id for r in df.collect()]
        assert len(ids) == len(set(ids)) == n and min(ids) >= 0
        assert sorted(ids) == sorted(r.doc_id for r in df.select("doc_id").collect())


def test_mix_of_sources_without_ids(spark, tmp_path):
    reg = _registry(spark, tmp_path)
    out = M.mixed(spark, reg, {"bare": 0.6, "named": 0.4}, strategy="all_exhausted_without_replacement").collect()
    assert len(out) == 110 and sorted(r.pos for r in out) == list(range(110))
