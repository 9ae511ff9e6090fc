"""Shares of a mix: documents are encoded before they are drawn."""


def test_a_document_of_a_mix_is_encoded_once(spark, tmp_path):
    from quire.plans import catalog, common

    rows = [(i, f"word{i % 5} and word{i % 3}", "en", f"src{i % 7}", 10) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    seen, plain = [], common.encode

    def watched(spark, sf_dir, df, *args, **kw):
        seen.append(df.count())
        return plain(spark, sf_dir, df, *args, **kw)

    common.encode = watched
    try:
        got = catalog.QUERIES["c_shares"](spark, str(tmp_path)).collect()
    finally:
        common.encode = plain
    assert seen == [120] and sum(r.n_docs for r in got) > 120
