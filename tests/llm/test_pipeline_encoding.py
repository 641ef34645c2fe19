"""What the last stages hand to Python helpers: whole texts in small batches, and only those that need it."""

import re

import corpus_pipeline
from quillon.llm import bpe


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_encoding_is_written_in_small_batches_whatever_reads_it(spark, documents):
    got = corpus_pipeline.encode(spark, documents, "")
    assert "MapInArrow" not in plan(got) and "Python" not in plan(got)
    coded = bpe.encode_decode(documents, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).collect()
    want = [(str(r["doc_id"]), [int(x) for x in r["ids"].split()]) for r in coded]
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got.collect()) == sorted(want)


def test_texts_without_secrets_do_not_go_to_the_helper(spark, documents):
    handed = re.findall(r"clean\((.+?), _spans", plan(corpus_pipeline.redact_secrets(spark, documents.drop("clash", "bands"), "")))
    assert handed and all(x.startswith("CASE WHEN isnotnull(_spans") for x in handed)
