"""Each row of the pipeline has its own decision, whatever its doc_id."""

import random
from collections import Counter

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(("sun", "moon", "river", "stone", "tree")) + str(rng.randrange(50)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS)


def test_near_dedup_examines_rows_without_id_and_of_equal_id(spark):
    rng = random.Random(8)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a, "s0"), (None, a + " more", "s0"), (None, b, "s0"), (None, b, "s0"), (7, c, "s0"), (7, d, "s0"), (3, d + " more", "s0")]
    got = corpus_pipeline.drop_near_copies(spark, table(spark, rows), "")
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted([("1", a), ("None", b), ("7", c), ("3", d + " more")])


def test_mixing_decides_row_by_row(spark):
    rng = random.Random(9)
    rows = [(None if k % 3 else 5, prose(rng, rng.randrange(20, 200)), f"s{k % 3}") for k in range(900)]
    docs = table(spark, rows)
    got = Counter(r["text"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert max(got.values()) <= 3
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
    taken = Counter()
    for _, text, source in rows:
        taken[source] += got[text] * len(text.split())
    total = sum(size.values())
    for k, source in enumerate(sorted(size)):
        assert abs(taken[source] - total * (k + 1) / 6) < total * 0.01
