import hashlib
import random
from collections import defaultdict

import pytest

from quillon.llm import fingerprints, mixing


def wanted_targets(sizes):
    """Targets by sharing again and again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(k % 3 + 1) for k, s in enumerate(order)}
    total, cut = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in order if s not in cut]
        spare, share = total - sum(cut.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * spare / share > 3 * sizes[s]]
        if not over:
            return cut | {s: weight[s] * spare / share for s in rest}
        cut |= {s: 3.0 * sizes[s] for s in over}


def test_mix_meets_its_targets(spark, documents):
    rng = random.Random(6)
    extra = [(1000 + i, "w " * rng.randrange(1, 200), f"big{i % 7}") for i in range(3000)] + [(9000, "tiny one", "zz")]
    docs = documents.select("doc_id", "text", "source", "clash").unionByName(spark.createDataFrame([(*r, "x") for r in extra], "doc_id long, text string, source string, clash string"))
    got = mixing.mix(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect() if r["doc_id"] is not None}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    want = wanted_targets(dict(sizes))
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["copies"] <= 3
        if r["doc_id"] is not None:
            s = source[r["doc_id"]]
            taken[s] += r["copies"] * r["size"]
            assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s]
    for s in [f"big{k}" for k in range(7)]:
        assert taken[s] == pytest.approx(want[s], rel=0.005)
    assert taken["zz"] == 6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_prefix_hashes_answer_span_questions():
    rng = random.Random(8)
    a, b = ("".join(rng.choice("abé") for _ in range(300)) for _ in range(2))
    b = b[:50] + a[100:180] + b[50:]
    x, y = fingerprints.Prefixes.of(a), fingerprints.Prefixes.of(b)
    for _ in range(300):
        i, j, n = rng.randrange(250), rng.randrange(250), rng.randrange(1, 20)
        assert fingerprints.same(x, i, y, j, n) == (a[i:i + n] == b[j:j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert fingerprints.common_extension(x, i, y, j) == k
    assert fingerprints.common_extension(x, 100, y, 50) >= 80
    joined, whole = x.join(120, y, 77), fingerprints.Prefixes.of(a[:120] + b[:77])
    assert all((p == q).all() for p, q in zip(joined.sums, whole.sums, strict=True))
    spans = x.spans(5)
    assert all((spans[i] == spans[j]) == (a[i:i + 5] == a[j:j + 5]) for i in range(0, 290, 7) for j in range(0, 290, 11))


def check_neighbours(docs, monkeypatch=None):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    got = sorted(((r["doc_id"] is None, -(r["doc_id"] or 0), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], r["fingerprint"], r["edited_fingerprint"]) for r in fingerprints.compare_neighbours(docs).collect()))
    want = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [fingerprints.fingerprint(p, fingerprints.sketch(p)) for p in map(fingerprints.Prefixes.of, (text, edited, after))]
        want.append((doc_id is None, -(doc_id or 0), len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.likeness(prints[0], prints[1]), fingerprints.likeness(prints[0], prints[2]), prints[0], prints[1]))
    assert got == sorted(want)
    return got


def test_neighbours_over_many_buckets(documents, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET", 5)
    got = check_neighbours(documents)
    assert all(0.0 <= r[4] <= 1.0 and 0.0 <= r[5] <= 1.0 for r in got)
    long_ones = [r for r in got if r[2] > 300]
    assert sum(r[4] for r in long_ones) / len(long_ones) > 0.2


def test_neighbours_of_one_row_and_none(documents, no_documents):
    check_neighbours(documents.where("doc_id = 3"))
    check_neighbours(documents.where("doc_id IS NULL"))
    assert fingerprints.compare_neighbours(no_documents).count() == 0


def test_likeness_estimates_the_share_of_spans(documents):
    texts = [r["text"] for r in documents.where("doc_id < 25").collect()]
    a = fingerprints.Prefixes.of(texts[0] + texts[1] + texts[2])
    b = fingerprints.Prefixes.of(texts[0] + texts[1] + texts[3])
    x, y = set(a.spans(16)), set(b.spans(16))
    near = fingerprints.likeness(*[fingerprints.fingerprint(p, fingerprints.sketch(p)) for p in (a, b)])
    assert abs(near - len(x & y) / len(x | y)) < 0.2


def test_large_ids_beside_null_ones_stay_whole(spark):
    rows = [(9007199254740993 + 2 * k, "a b c", "s") for k in range(5)] + [(None, "a b c d", "s"), (None, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)


def test_rows_of_one_id_and_size_are_spread(spark, monkeypatch):
    """Thousands of rows without doc_id, all of one size, share many buckets; reruns agree whatever the partitions."""
    from pyspark.sql import functions as F

    seen = []
    real = mixing.placed
    monkeypatch.setattr(mixing, "placed", lambda *a: seen.append(real(*a)) or seen[-1])
    monkeypatch.setattr(mixing, "PLACED", 1000)
    monkeypatch.setattr(mixing, "BUCKET", 500)
    rows = [(None, "s0", "one two three")] * 6000 + [(k, "s1", "w " * (k % 40)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs)
    buckets = seen[0].withColumn("bucket", F.col("pos") % F.ceil(F.col("n") / 500).cast("long")).groupBy("sid", "bucket").count()
    assert buckets.agg(F.max("count")).first()[0] <= 500 and seen[0].select("part").distinct().count() > 4

    def counted(df):
        return sorted(tuple(map(str, r)) for r in df.groupBy("doc_id", "size", "target", "copies").count().collect())

    first = counted(got)
    assert first == counted(mixing.mix(docs.repartition(7)))
    by = {r["source_size"]: (r["taken"], r["target"]) for r in got.groupBy("source_size", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()}
    assert all(abs(taken - target) <= 0.005 * target for taken, target in by.values())


def test_rates_meet_their_targets_or_fail(spark):
    """Brute force: bisection of the dual in plain Python; and a loop that is too short is an error, not a result."""
    import math
    import random

    import pytest

    rng = random.Random(3)
    sizes = {s: [max(1, int(rng.lognormvariate(4, 1.5))) for _ in range(400)] for s in (1, 2, 3)}
    targets = {1: 0.2 * sum(sizes[1]), 2: 1.7 * sum(sizes[2]), 3: 2.97 * sum(sizes[3])}
    hist = spark.createDataFrame([(s, n) for s, own in sizes.items() for n in own], "sid int, size long")
    wanted = spark.createDataFrame(list(targets.items()), "sid int, target double")
    got = {r["sid"]: r["lambda"] for r in mixing.solve_rates(hist, wanted, tolerance=1e-6).collect()}

    def value(s, rate):
        return sum(min(3.0, math.exp(min(rate * x, 50))) * x for x in sizes[s])

    for s, target in targets.items():
        low, high = -1.0, 3.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if value(s, mid) < target else (low, mid)
        assert abs(value(s, got[s]) / target - 1) <= 1e-6 and abs(value(s, low) / value(s, got[s]) - 1) <= 2e-6
    with pytest.raises(RuntimeError):
        mixing.solve_rates(hist, wanted, tolerance=1e-9, rounds=2)
