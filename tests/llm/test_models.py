"""Language ID, class n-grams, quality resampling."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import brown, langid, quality
from quillon.llm.common import held_out

ALPHABETS = {"en": ["the", "ing", "th", "er", "ou"], "de": ["sch", "ung", "ein", "ich", "ß"], "fr": ["eau", "é", "que", "oux", "ez"], "es": ["ción", "ñ", "os", "ado", "ll"]}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages_are_told_apart_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, invented(rng, lang, rng.randrange(20, 60)), lang, "x") for i in range(400) for lang in [rng.choice("en de fr es".split())]]
    rows += [(900, None, "en", "x"), (901, "", "en", "x"), (902, "12 ½ !!", "fr", "x"), (903, "schung", None, "x"), (None, "schung einich", "de", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    held = held_out(F.col("doc_id"), 3, 1)
    model = langid.fit(docs.where(~held).select(F.col("doc_id").alias("key"), "text", "lang"))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert len(got) == len(rows) and all(0.0 <= r["score"] <= 1.0 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "de"
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:400]) >= 396
    assert langid.keep_identified(docs, model).count() == len(rows) - 3


def test_language_models_of_few_languages_and_none(spark):
    one = spark.createDataFrame([(1, "abc", "xx")], "key long, text string, lang string")
    assert langid.fit(one).predict("abc") == ("xx", 1.0)
    assert langid.fit(one.limit(0)).predict("abc") == ("und", 0.0)
    two = langid.fit(spark.createDataFrame([(k, "aaa bbb" if k % 2 else "ccc ddd", "en" if k % 2 else "fr") for k in range(8)], "key long, text string, lang string"))
    assert two.predict("aaa")[0] == "en" and two.predict("ccc")[0] == "fr"


def test_scores_match_counts_and_the_class_model(spark, documents):
    held = held_out(F.col("doc_id"), 7, 2)
    model, rare = brown.fit(documents.where(~held))
    rows = documents.withColumn("h", held).collect()
    counts, n_docs = Counter(), 0
    for r in rows:
        if not r["h"]:
            counts.update((r["text"] or "").encode().lower().split())
            n_docs += 1
    n, v = sum(counts.values()) + n_docs, len(counts) + 1
    got = brown.score(documents, model, rare).collect()
    assert len(got) == len(rows)

    def want(text):
        own = (text or "").encode().lower().split()
        return len(own) + 1, sum(counts[w] > 0 for w in own) + 1, n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) + math.log10((n_docs + 1) / (n + v + 1))

    expect = sorted((str(r["doc_id"]), *[round(x, 4) for x in want(r["text"])]) for r in rows)
    assert sorted((str(r["doc_id"]), *[round(r[c], 4) for c in ("n_tokens", "n_known", "train_tokens", "base_score")]) for r in got) == expect
    assert all(r["score"] < 0 for r in got)
    assert np.allclose((10**model.steps).sum(1), 1.0)
    assert brown.score(documents.limit(0), model, rare).count() == 0


def test_rarer_words_meet_their_counts(spark, documents, monkeypatch):
    """The same scores with hardly any word among the top ones."""
    whole = {r["doc_id"]: r for r in brown.score(documents.where("doc_id < 90"), *brown.fit(documents)).collect()}
    top = brown.top_words
    monkeypatch.setattr(brown, "top_words", lambda vocabulary, most=0: top(vocabulary, 6))
    few = {r["doc_id"]: r for r in brown.score(documents.where("doc_id < 90"), *brown.fit(documents)).collect()}
    for i, r in whole.items():
        assert abs(r["base_score"] - few[i]["base_score"]) < 1e-6 and r["n_known"] == few[i]["n_known"]


def test_an_empty_corpus_scores_nothing_as_certain(spark, no_documents, documents):
    got = brown.score(documents.where("doc_id = 303"), *brown.fit(no_documents)).first()
    assert got["n_tokens"] == 2 and got["n_known"] == 0 and got["base_score"] == 0.0


def test_exchange_finds_alternating_classes():
    grid = np.zeros((brown.UNITS, brown.UNITS), np.int64)
    for a in range(10):
        for b in range(10):
            if a % 2 != b % 2:
                grid[a, b] = 50 + a + b
    of = brown.exchange(grid, classes=3)
    assert len(set(of[:10:2])) == 1 and len(set(of[1:10:2])) == 1 and of[0] != of[1]


def test_quality_draws_good_text(spark):
    rng = random.Random(9)
    good, bad = [f"good{i}" for i in range(50)], [f"bad{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(40)), "x") for i in range(300)] + [(400, None, "x"), (401, "", "x"), (None, "good1 good2", "x"), (402, "good1", "x"), (402, "good1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 200)] + [(1, 0, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.resample(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert sum(i in kept for i in range(1, 300, 2)) >= 148 and abs(len([r for r in got if r["kept"]]) - 153) <= 3
    assert {r["doc_id"]: r["log_weight"] for r in got}[400] == 0.0
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    scores = quality.resample(docs, labels, share=0.1)
    assert sorted((r["gumbel_key"] for r in scores.where("kept").collect()), reverse=True) == keys[: math.ceil(len(rows) * 0.1)]
    assert quality.resample(docs.limit(0), labels).count() == 0 and quality.resample(docs, labels.limit(0)).where("kept").count() == len(rows)


def test_nth_largest_is_exact(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 1000) for _ in range(3000)] + [5.0] * 500 + [1e9]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for k in (1, 2, 700, 3501):
        assert quality.nth_largest(df, "x", k, bins=16, few=20) == sorted(values, reverse=True)[k - 1]
