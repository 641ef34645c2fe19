import numpy as np
from pyspark.sql import functions as F

from quillon.adapters import DICTIONARIES, small_catalogue
from quillon.operators import vectors
from quillon.plans import preprocess as plans
from quillon.schema import CATALOGUE
from quillon.sources import files

VECTORS = "id string, embedding array<float>"


def test_topk_of_many_queries_is_the_full_ranking(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 7)
    monkeypatch.setattr(vectors, "BLOCK", 3)
    draw = np.random.default_rng(5)
    made = {f"i{n}": draw.integers(-2, 3, 6).astype(float).tolist() for n in range(60)}
    odd = [("null", None), ("part", [1.0, None, 1.0, 1.0, 1.0, 1.0]), ("nan", [float("nan")] * 6), ("short", [1.0, 2.0]), ("empty", [])]
    pool = spark.createDataFrame([*made.items(), *odd], VECTORS)
    queries = spark.createDataFrame([(f"q{n}", made[f"i{n}"]) for n in range(8)] + [("two", [1.0, 0.0]), ("none", None)], VECTORS).withColumnRenamed("id", "query_id")
    items = pool.where("id <> 'i3'").select("id", F.lit(1).alias("embedding"))
    for k in (1, 9, 1000):
        got = vectors.semantic_topk_queries(items, pool, queries, k).collect()
        for n in range(8):
            q = np.array(made[f"q{n}".replace("q", "i")])
            score = {i: round(float(np.dot(v, q) / max(np.linalg.norm(v), 1e-12) / max(np.linalg.norm(q), 1e-12)) * 100, 6) for i, v in made.items() if i != "i3"}
            want = sorted(score, key=lambda i: (-score[i], i))[:k]
            assert [r["id"] for r in sorted((r for r in got if r["query_id"] == f"q{n}"), key=lambda r: r["rank"])] == want
        assert [r["id"] for r in got if r["query_id"] == "two"] == ["short"] and not [r for r in got if r["query_id"] == "none"]
    assert vectors.semantic_topk_queries(items, pool, queries.limit(0)).count() == 0
    assert vectors.semantic_topk_queries(items.limit(0), pool, queries).count() == 0


def test_few_rows_come_out_of_either_pass(spark):
    """At k = 5000 of 20,000 vectors in clusters: little over k rows a query, equal to the full ranking, ties included."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 8)) * 3
    x = np.round(centres[draw.integers(0, 12, 20_000)] + draw.normal(size=(20_000, 8)), 1)
    pool = spark.createDataFrame([(f"v{n:05d}", v.tolist()) for n, v in enumerate(x)], "id string, embedding array<double>").repartition(4)
    queries = pool.where("id < 'v00004'").withColumnRenamed("id", "query_id")
    for cosine, k in ((True, 5000), (False, 5000), (False, 3)):
        got = vectors.nearest(pool, queries, k, cosine)
        rows = got.collect()
        for n in range(4):
            q = x[n]
            s = np.round(x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)) if cosine else x @ q, 6)
            order = np.lexsort((np.arange(len(x)), -s))[:k]
            mine = sorted((r for r in rows if r["query_id"] == f"v{n:05d}"), key=lambda r: r["rank"])
            score = {r["id"]: r["score"] for r in mine}
            assert len(score) == k and np.allclose(sorted(score.values()), np.sort(s[order]), atol=2e-6)
        out = rows_made(got, "MapInArrow")
        assert 4 * k <= out <= 4 * 2 * k + 400, out


def rows_made(df, name):
    """Rows that a node of an executed frame has put out."""
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plan.append(node.plan())
        else:
            if node.nodeName() == name:
                found.append(node.metrics().apply("pythonNumRowsReceived").value())
            children = node.children()
            plan += [children.apply(k) for k in range(children.size())]
    return max(found)


def test_covers_and_images_for_tables_of_queries(spark):
    draw = np.random.default_rng(6)
    made = {f"IT{n}": draw.normal(size=5).tolist() for n in range(30)}
    index = spark.createDataFrame([(f"/{i}", "s" if n % 2 else "t", f"{i}.jpg", i, v) for n, (i, v) in enumerate(made.items())], "path string, source string, name string, item_id string, embedding array<double>")
    vecs = index.select("item_id", "embedding")
    found = vectors.cover_topk_queries(vecs, spark.createDataFrame([(" it3 ",), ("IT3",), ("none",)], "query_id string"), vecs.where("item_id <> 'IT5'").select(F.lower("item_id").alias("id")), 7)
    one = vectors.cover_topk(vecs, "it3", candidates=vecs.where("item_id <> 'IT5'").select(F.col("item_id").alias("id")), k=7)
    assert [(r["query_id"], r["rank"], r["id"]) for r in found.orderBy("rank").collect()] == [("IT3", r["rank"], r["id"]) for r in one.orderBy("rank").collect()]
    asked = spark.createDataFrame([("a", made["IT1"]), ("b", made["IT2"])], "query_id string, embedding array<double>")
    many = vectors.image_topk_queries(index, asked, 4, "s").collect()
    for q, i in (("a", "IT1"), ("b", "IT2")):
        single = vectors.image_topk(index, made[i], 4, "s").orderBy("rank").collect()
        assert [r["path"] for r in sorted((r for r in many if r["query_id"] == q), key=lambda r: r["rank"])] == [r["path"] for r in single]


def test_an_inconsistent_index_is_built_anew_in_manifest_order(spark):
    seen = spark.sparkContext.accumulator(0)

    def encoder(values):
        seen.add(len(values))
        return np.ones((len(values), 4))

    manifest = spark.createDataFrame([(f"/{i}", "s", "n", "i", 1, 1, "x", -i) for i in range(6)], "path string, source string, name string, item_id string, size long, mtime_ns long, content string, pos long")
    index = vectors.refresh_index(None, manifest, encoder, "m", order=("pos",)).collect()
    assert [r["path"] for r in index] == [f"/{i}" for i in reversed(range(6))] and seen.value == 6
    schema = "path string, source string, name string, item_id string, size long, mtime_ns long, embedding array<float>"

    def refreshed(rows):
        before = seen.value
        assert len(vectors.refresh_index(spark.createDataFrame(rows, schema), manifest, encoder, "m", "m").collect()) == 6
        return seen.value - before

    plain = [tuple(r) for r in index]
    assert refreshed(plain) == 0
    assert refreshed([*plain, plain[0]]) == 6
    assert refreshed([*plain[1:], (*plain[0][:-1], None)]) == 6
    assert refreshed([*plain[1:], (*plain[0][:-1], [1.0])]) == 6
    assert refreshed([*plain[1:], (*plain[0][:-1], [1.0, None, 1.0, 1.0])]) == 6
    assert refreshed([]) == 6


def test_a_batch_that_repeats_an_id_keeps_its_last_row(spark):
    def table(rows):
        return spark.createDataFrame([(i, t, *[""] * (len(CATALOGUE) - 2), n) for n, (i, t) in enumerate(rows)], ", ".join(f"{c} string" for c in ["id", "title", *[c for c in CATALOGUE if c not in ("id", "title")]]) + ", pos long")

    current = table([("a", "old"), ("b", "old"), (None, "old")]).drop("pos")
    batch = table([("a", "z"), ("a", "y"), (None, "new"), (None, "new"), ("c", None)])

    def titles(df):
        return sorted((str(r["id"]), str(r["title"])) for r in df.select("id", "title").collect())

    rest = [("None", "new"), ("None", "new"), ("None", "old")]
    assert titles(files.upsert_catalogue(current, batch, ["pos"])) == sorted([("a", "y"), ("b", "old"), ("c", "None"), *rest])
    assert titles(files.upsert_catalogue(current, batch)) == sorted([("a", "z"), ("b", "old"), ("c", "None"), *rest])


def test_features_are_reused_while_the_fingerprint_stays(spark, tmp_path):
    df = small_catalogue(spark, "/root/testdata/sf0.001")
    folder = f"file://{tmp_path}/prepared"

    def stored():
        return sorted(p.name for p in (tmp_path / "prepared").iterdir())

    fresh, first = plans.preprocess(df, DICTIONARIES, keep=False), plans.preprocess_stored(df, DICTIONARIES, folder)
    assert sorted(map(str, fresh.items.collect())) == sorted(map(str, first.items.collect()))
    assert sorted(map(str, fresh.freqs.together().collect())) == sorted(map(str, first.freqs.together().select(*fresh.freqs.together().columns).collect()))
    one = stored()
    items = tmp_path / "prepared" / one[0] / "items"
    times = {p: p.stat().st_mtime_ns for p in items.iterdir()}
    plans.preprocess_stored(df, DICTIONARIES, folder)
    assert stored() == one and times == {p: p.stat().st_mtime_ns for p in items.iterdir()}
    (items.parent / "done" / "_SUCCESS").unlink()
    for p in (items.parent / "done").glob("*.parquet"):
        p.unlink()
    plans.preprocess_stored(df, DICTIONARIES, folder)  # what a broken-off run has left is written anew
    assert times != {p: p.stat().st_mtime_ns for p in items.iterdir()}
    plans.preprocess_stored(df.withColumn("title", F.lit("other")), DICTIONARIES, folder)
    assert len(stored()) == 2
    empty = plans.preprocess_stored(df.limit(0), DICTIONARIES, folder)
    assert empty.items.count() == 0 and empty.freqs.tags.count() == 0


def test_item_means_of_odd_vectors(spark):
    draw = np.random.default_rng(8)
    rows = [(f"i{draw.integers(0, 5)}" if n % 3 else "hot", draw.normal(size=4).tolist()) for n in range(300)]
    odd = [("hot", None), ("hot", []), ("hot", [1.0, None]), (None, [1.0]), (" ", [1.0]), ("mixed", [3.0, 4.0]), ("mixed", [2.0])]
    df = spark.createDataFrame([*rows, *odd], "item_id string, embedding array<double>")
    want = {}
    for item in {i for i, _ in rows}:
        mean = np.mean([np.array(v) / np.linalg.norm(v) for i, v in rows if i == item], axis=0)
        want[item] = mean / np.linalg.norm(mean)
    want["mixed"] = np.array([0.8, 0.8]) / np.linalg.norm([0.8, 0.8])
    for parts in (1, 7):
        got = {r["item_id"]: r["embedding"] for r in vectors.item_vectors(df.repartition(parts)).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)
    assert vectors.item_vectors(df.limit(0)).count() == 0
