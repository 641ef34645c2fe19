"""Results by row, whatever ids repeat or are missing, and stored orders."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import features, filters, rank, scoring
from quillon.plans import preprocess as plans
from quillon.sources import scratch


def test_parse_tags_by_row_in_both_forms(spark):
    df = spark.createDataFrame([("", "a, b", 1), ("", "c", 2), (None, "d", 3), ("x", None, 4), ("x", "b,,a, b", 5)], "id string, tags string, _row int")
    stops, mapped = spark.createDataFrame([("b",)], "term string"), spark.createDataFrame([("a", "A")], "term string, mapped string")
    want = {1: ["A"], 2: ["c"], 3: ["d"], 4: [], 5: ["", "A"]}
    for out in (features.parse_tags(df, {"b"}, {"a": "A"}), features.parse_tags_joined(df, stops, mapped)):
        assert {r["_row"]: r["parsed_tags"] for r in out.collect()} == want and out.columns == [*df.columns, "parsed_tags"]
    plain = features.parse_tags_joined(df, stops.limit(0), mapped.limit(0))
    assert {r["_row"]: r["parsed_tags"] for r in plain.collect()} == {1: ["a", "b"], 2: ["c"], 3: ["d"], 4: [], 5: ["b", "", "a", "b"]}


def test_block_tags_by_row_in_both_forms(spark):
    df = spark.createDataFrame([("", ["q"], 1), ("", ["c"], 2), (None, ["q"], 3), ("n", ["k"], 4), (None, ["k", None], 5), ("m", None, 6)], "id string, parsed_tags array<string>, n int")
    for out in (filters.block_tags(df, ["q"]), filters.block_tags_joined(df, spark.createDataFrame([("q",), ("q",)], "tag string"))):
        assert sorted(r["n"] for r in out.collect()) == [2, 4, 5, 6] and out.columns == df.columns


ITEMS = "id string, author string, parsed_tags array<string>, title_words array<string>, n int"


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_scores_by_row_in_both_forms(spark, most):
    """most = 0 takes the joined form."""
    rng = random.Random(5)
    rows = [(rng.choice(["A", "", None, f"i{k}"]), rng.choice(["ann", " bo", "", None]), [rng.choice("abcd") for _ in range(rng.randrange(5))], [rng.choice("xy") for _ in range(rng.randrange(3))], k) for k in range(60)]
    rows += [("z", "bo", None, [None, "x"], 60), ("A", "ann", ["a"], ["x"], 61), ("A", "ann", ["a"], ["x"], 62)]
    items = spark.createDataFrame(rows, ITEMS)
    freqs = scoring.all_frequencies(items)
    got = {r["n"]: r["score"] for r in scoring.recommend(items, freqs, most=most).collect()}
    one = spark.createDataFrame([(f"u{r[4]}", *r[1:]) for r in rows], ITEMS)  # the same with an id of its own for each row
    assert len(got) == len(rows) and got == {r["n"]: r["score"] for r in scoring.recommend(one, freqs).collect()} and got[61] == got[62]
    tags = {r[0]: r[1] for r in freqs.tags.collect()}
    import math

    for f, name in ((lambda: scoring.tag_score(items.withColumn("id", F.col("n").cast("string")), freqs.tags, most=most), "tag_score"),):
        for r in f().collect():
            own = rows[int(r["id"])][2] or []
            assert r[name] == pytest.approx(sum(math.log1p(tags[t]) * 10 for t in own) / math.sqrt(max(len(own), 1)) * 0.5)
    bonus = spark.createDataFrame([("tag", "a", 2.0), ("author", "bo", 3.0), ("title_word", "x", 5.0)], "facet string, feature string, bonus double")
    for r in scoring.history_score(items.withColumn("id", F.col("n").cast("string")), bonus, 2.0, most).collect():
        _, author, own, words, _ = rows[int(r["id"])]
        own = own or []
        want = 2.0 * own.count("a") / math.sqrt(max(len(own), 1)) + 5.0 * words.count("x") / math.sqrt(max(len(words), 1)) + (3.0 if (author or "").strip() == "bo" else 0.0)
        assert r["history_score"] == pytest.approx(2.0 * want)
    assert scoring.recommend(items.limit(0), freqs, most=most).count() == 0


def test_the_page_scores_without_a_shuffle_by_id(spark):
    items = spark.createDataFrame([("a", "ann", ["t"], ["w"], 1)], ITEMS)
    plan = scoring.recommend(items, scoring.all_frequencies(items))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan


def test_bounds_and_rows_come_from_one_scoring(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(x):
        seen.add(1)
        return x - 3

    df = spark.range(10).select(F.udf(score, "int")("id").alias("score"), F.col("id").cast("string"))
    assert filters.min_score(df).count() == 7 and seen.value == 10


def files_read(df):
    """Files that the scan of an executed frame has read."""
    plan, found = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        children = node.children()
        plan += [children.apply(k) for k in range(children.size())]
        if node.metrics().contains("numFiles"):
            found += node.metrics().apply("numFiles").value()
    return found


def test_stored_order_pages(spark):
    rng = random.Random(2)
    rows = [(f"i{k}", rng.randrange(50), f"2024-01-{k % 28 + 1:02d}") for k in range(997)] + [("same", 7, "2024-01-01")] * 40
    df = spark.createDataFrame(rows, "id string, score int, upload_date string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = rank.store_order(df, rank.sort_order())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(sorted(sorted(rows), key=lambda r: r[2], reverse=True), key=lambda r: r[1], reverse=True)
    for page in (0, 3, 11, 1036 // 90, 12):
        got = [tuple(r) for r in order.page(page, 90).select("id", "score", "upload_date").collect()]
        assert [(r[1], r[2], r[0]) for r in got] == [(r[1], r[2], r[0]) for r in want[page * 90:page * 90 + 90]]
    assert order.count() == len(rows) and len(order.parts) > 1
    page = order.page(3, 90)
    page.collect()
    assert 1 <= files_read(page) <= 2 < len(order.parts), "a page reads the partitions that hold it"
    empty = rank.store_order(df.limit(0), rank.sort_order())
    assert empty.page(0).count() == 0 and empty.placed().count() == 0 and "place" in empty.placed().columns


def test_a_view_is_kept_and_made_anew_when_the_catalogue_changes(spark, tmp_path):
    from quillon.adapters import DICTIONARIES, small_catalogue

    df, folder = small_catalogue(spark, "/root/testdata/sf0.001"), f"file://{tmp_path}/views"

    def views():
        return sorted(p.name for p in (tmp_path / "views").glob("view-*"))

    def look(catalogue, **how):
        return plans.view_stored(plans.preprocess_stored(catalogue, DICTIONARIES, folder), folder, **how)

    first = look(df)
    one = views()
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "views").rglob("*.parquet")}
    again = look(df)
    assert views() == one and times == {p: p.stat().st_mtime_ns for p in (tmp_path / "views").rglob("*.parquet")}
    single = plans.recommend_page(plans.preprocess(df, DICTIONARIES), page_index=1, size=30)
    for v in (first, again):
        assert [r["id"] for r in v.page(page_index=1, size=30).collect()] == [r["id"] for r in single.collect()]
    term = "brand#1"
    plain = filters.keyword_search(filters.min_score(scoring.recommend(*(lambda p: (p.items, p.freqs))(plans.preprocess(df, DICTIONARIES)))), term)
    assert [r["id"] for r in first.page(term, 0, 20).collect()] == [r["id"] for r in rank.page(plain, rank.sort_order(), 0, 20).collect()]
    look(df, blocked=["crimson"])
    look(df.withColumn("title", F.lit("other")))
    assert len(views()) == 3


def test_scratch_tables_have_an_owner(spark):
    held = scratch.stored(spark.range(5), "mine")
    assert held.count() == 5 and all(scratch.folder(spark).rpartition("/")[2] in f for f in held.inputFiles())
    assert scratch.unused(spark.range(1).toDF("_row"), "_row") == "_row_"
