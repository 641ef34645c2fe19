from quillon.llm import langid


def test_texts_stay_where_no_language_could_be_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "12 !!", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs.selectExpr("doc_id AS key", "text", "lang"))
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs, model).collect()) == [1, 4]
