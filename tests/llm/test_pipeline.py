import os
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import secret_scan
from test_near import brute


@pytest.fixture(scope="module")
def folder(documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    documents.drop("clash", "bands").write.parquet(os.path.join(path, "documents.parquet"))
    return path


def test_stages_take_effect_one_after_the_other(spark, documents, folder):
    docs = documents.drop("clash", "bands")
    columns, rows = docs.columns, docs.collect()
    stage = dict(corpus_pipeline.STAGES)
    one = corpus_pipeline.written(stage["language ID"](spark, docs, folder), "t1")
    letters = [r for r in rows if r["text"] and any(map(str.isalpha, r["text"]))]
    assert one.columns == columns and sorted(map(str, one.collect())) == sorted(map(str, letters))
    two = corpus_pipeline.written(stage["MinHash near-dedup"](spark, one, folder), "t2")
    # every row counts by itself, the one without doc_id too: the first of its group in order of doc_id, null last, stays
    letters.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    component = brute([(k, r["text"]) for k, r in enumerate(letters)], 5, 80)
    assert two.columns == columns
    assert sorted(str(r["doc_id"]) for r in two.collect()) == sorted(str(letters[k]["doc_id"]) for k, c in component.items() if k == c)
    three = corpus_pipeline.written(stage["secret scans"](spark, two, folder), "t3")
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in (two, three))
    assert set(before) == set(after) and three.columns == columns
    for i, r in after.items():
        assert r["text"] == secret_scan.redact(before[i]["text"], secret_scan.find(before[i]["text"], secret_scan.RULES, set(secret_scan.rule_ids())))
        assert i == 307 or r["n_chars"] == len(r["text"])
    assert "[secret]" in after[309]["text"]
    four = corpus_pipeline.written(stage["mixing sources to target weights"](spark, three, folder), "t4")
    times = Counter(r["doc_id"] for r in four.collect())
    assert four.columns == columns and set(times) <= set(after) and max(times.values()) <= 3
    five = stage["BPE encoding and decoding"](spark, four, folder).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert Counter(r["doc_id"] for r in five) == times
    for r in five:
        assert r["ids"] == library.encode(after[r["doc_id"]]["text"], add_special_tokens=False).ids


def test_run_is_the_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids"]
