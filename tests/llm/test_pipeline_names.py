"""Columns of documents that bear the names of helpers come through all stages; so does an empty table."""

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, findings string, blob_id string, clean string, _row long, _copies string, copies string, component_id long, size string"


def test_clashing_columns_and_an_empty_table(spark):
    rows = [(k, f"words of document number {k} that say this and that " * 3, "en", f"s{k % 2}", 1) for k in range(30)] + [(None, "a token = abcdef123456 is here", "en", None, 1), (99, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "f", "b", "c", 7, "x", "y", 8, "z") for r in rows], DOCS)
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns
    found = out.collect()
    assert {tuple(r)[5:] for r in found} == {("f", "b", "c", 7, "x", "y", 8, "z")}
    assert not any("abcdef123456" in r["text"] for r in found)
    out = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "")
        assert out.count() == 0
