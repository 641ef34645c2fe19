"""Votes of language ID and weights of quality resampling, recomputed row by row in plain Python."""

import math
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import langid, quality
from quillon.llm.common import held_out

WORD_64 = (1 << 64) - 1


def grams(text, size):
    """Bucket of each word and of each pair of neighbours, by integers."""
    h = [xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()]
    pairs = []
    for x, y in zip(h, h[1:]):
        p = (x * 0x9E3779B97F4A7C15 & WORD_64) ^ y
        pairs.append((p ^ (p >> 29)) * 0x9E3779B97F4A7C15 & WORD_64)
    return [(x >> 16) % size for x in h + pairs]


@pytest.mark.parametrize("size", [64, 10_000])
def test_weights_keys_and_the_draw_are_those_of_plain_counts(spark, documents, size):
    docs = documents.select("doc_id", "text", F.lit("x").alias("log_weight"))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()] + [(9999, "very long " * 60_000)]
    docs = docs.unionByName(spark.createDataFrame([(9999, "very long " * 60_000, "x")], docs.schema))
    labels = spark.createDataFrame([(i, 1 if i % 3 == 0 else 0) for i in range(0, 400)], "doc_id long, quality int")
    every, target = Counter(), Counter()
    for k, text in rows:
        every.update(grams(text, size))
        if k is not None and k < 400 and k % 3 == 0:
            target.update(grams(text, size))
    n_every, n_target = sum(every.values()) + size, sum(target.values()) + size
    want = Counter()
    for k, text in rows:
        weight = sum(math.log((target[b] + 1) / n_target) - math.log((every[b] + 1) / n_every) for b in grams(text, size))
        u = (xxhash.xxh3_64_intdigest(f"{k}\n".encode() + text.encode(), 17) + 0.5) / 2.0**64
        want[(k, len(grams(text, size)), round(weight, 4), round(weight - math.log(-math.log(min(u, 1 - 2.0**-53))), 4))] += 1
    got = quality.resample(docs, labels, share=0.25, size=size).collect()
    assert Counter((r["doc_id"], r["n_grams"], round(r["log_weight"], 4), round(r["gumbel_key"], 4)) for r in got) == want
    edge = sorted((x[3] for x in want.elements()), reverse=True)[math.ceil(len(rows) * 0.25) - 1]
    assert all(r["kept"] == (round(r["gumbel_key"], 4) >= edge) for r in got)


def test_predictions_are_the_votes_of_the_machines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"), 3, 1)).select(F.col("doc_id").alias("key"), "text", "lang"))
    shown = docs.where("doc_id % 5 = 0").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 ."), (-4, "the " * 200_000), (-5, "the same"), (-5, "the same"), (None, "the same")], shown.schema)
    rows = shown.unionByName(odd)
    want = Counter()
    for r in rows.collect():
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            want[(r["doc_id"], "und", 0.0)] += 1
            continue
        margin = dict(zip(model.contests, langid.features(text) @ model.weights + model.offsets))

        def winner(kind, names):
            won, total, least = Counter(), defaultdict(float), dict.fromkeys(names, 1.0)
            for (k, a, b), m in margin.items():
                if k == kind and a in names and b in names:
                    p = 1 / (1 + math.exp(-min(30, max(-30, 4 * m))))
                    won[a if m >= 0 else b] += 1
                    total[a] += m
                    total[b] -= m
                    least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
            best = sorted(names, key=lambda x: (won[x], total[x], x))[-1]
            return best, least[best]

        fam, p = winner("family", {langid.family(x) for x in model.langs})
        lang, q = winner("lang", {x for x in model.langs if langid.family(x) == fam})
        want[(r["doc_id"], lang, round(p * q, 9))] += 1
    got = langid.identify(rows, model)
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got.collect()) == want
    assert langid.identify(rows.limit(0), model).count() == 0
