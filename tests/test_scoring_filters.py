import math
import random
from collections import Counter

from pyspark.sql import functions as F

from quillon.operators import context, filters, rank, scoring

ITEMS = "id string, author string, parsed_tags array<string>, title_words array<string>, upload_date string, search_text string"


def random_items(rng, n=60):
    return [(f"I{i}", rng.choice(["ann", " bo ", "", "a, b"]), [rng.choice("abcd") for _ in range(rng.randrange(5))], [rng.choice("xyz") for _ in range(rng.randrange(3))], f"2024-01-{rng.randrange(10, 28)}", f"text {i % 7}") for i in range(n)]


def restated(items, weights, g, history, scales):
    tags, words = Counter(t for r in items for t in r[2]), Counter(w for r in items for w in r[3])
    authors = Counter(r[1].strip() for r in items if r[1].strip())

    def bonus(counter, freq, scale):
        total = max(sum(freq.values()), 1)
        return {k: n * math.log1p((total + 1) / (freq.get(k, 0) + 1)) * scale for k, n in counter.items()} if counter and scale > 0 else {}

    ht, hw = Counter(t for h in history for t in set(h[0]) if t), Counter(t for h in history for t in set(h[1]))
    ha = Counter(h[2].strip() for h in history if h[2].strip())
    bt, ba, bw = bonus(ht, tags, scales[0]), bonus(ha, authors, scales[1]), bonus(hw, words, scales[2])
    out = {}
    for i, author, ts, ws, *_ in items:
        nt, nw, a = math.sqrt(max(len(ts), 1)), math.sqrt(max(len(ws), 1)), author.strip()
        s = sum(math.log1p(tags[t]) * 10 * weights[0].get(t, 1.0) for t in ts) / nt * g.tag * 0.5
        s += sum(math.log1p(words[w]) * 10 * weights[2].get(w, 1.0) for w in ws) / nw * g.title
        s += math.log1p(authors[a]) * 10 * weights[1].get(a, 5.0) * g.author if a else 0
        if g.history > 0:
            s += (sum(bt.get(t, 0) for t in ts) / nt + sum(bw.get(w, 0) for w in ws) / nw + ba.get(a, 0)) * g.history
        out[i] = int(round(s, 6))
    return out


def test_recommend_is_the_sum_of_its_parts(spark):
    rng = random.Random(3)
    for round_ in range(2):
        rows = random_items(rng)
        weights = ({"a": -3.5, "nope": 9.0}, {"ann": -2.0}, {"x": 0.25})
        history = [([rng.choice("abe") for _ in range(3)], [rng.choice("xyq")], rng.choice(["ann", "", "new"])) for _ in range(6)]
        g, scales = scoring.Multipliers(1.5, 0.5, 2.0, 0.7 * round_), (1.0, 0.5, 0.0)
        items = spark.createDataFrame(rows, ITEMS)

        def freq(col, df=items):
            return df.select(F.explode(col).alias("feature")).groupBy("feature").agg(F.count("*").alias("freq"))

        authors = items.select(F.trim("author").alias("feature")).where("feature <> ''").groupBy("feature").agg(F.count("*").alias("freq"))
        freqs = scoring.Frequencies(freq("parsed_tags"), authors, freq("title_words"))
        tables = scoring.Weights(*[spark.createDataFrame(list(w.items()), "feature string, weight double") for w in weights])
        entries = spark.createDataFrame(history, "tags array<string>, title_words array<string>, author string")
        got = scoring.recommend(items, freqs, tables, g, entries, scales)
        want = restated(rows, weights, g, history, scales)
        assert {r["id"]: r["score"] for r in got.collect()} == want
        again = scoring.recommend(items.repartition(5), freqs, tables, g, entries, scales)
        assert {r["id"]: r["score"] for r in again.collect()} == want
        assert min(want.values()) < 0 < max(want.values())


def scored(spark, rows):
    return spark.createDataFrame(rows, "id string, score int, upload_date string, parsed_tags array<string>, search_text string, title string, tags string, author string, team string, link string")


ROWS = [("a", 5, "2024-01-01", ["x"], "a one two", "T", "tag", "au", "", "l"), ("b", 5, "2024-01-03", ["y", "x"], "b one", "T", "tag", "au", "", "l"), ("c", -2, "2024-01-02", [], "c", "T", "one", "au", "", "l")]


def test_filters(spark):
    df = scored(spark, ROWS)
    assert tuple(filters.score_bounds(df).first()) == (-2, 5, 0)
    assert tuple(filters.score_bounds(df.where("score = 5")).first()) == (5, 6, 5)
    assert tuple(filters.score_bounds(df.limit(0)).first()) == (0, 100, 0)
    assert {r["id"] for r in filters.min_score(df).collect()} == {"a", "b"} and filters.min_score(df, -2).count() == 3
    assert [r["id"] for r in filters.block_tags(df, ["y"]).collect()] == ["a", "c"] and filters.block_tags(df, []).count() == 3
    assert {r["id"] for r in filters.block_tags_joined(df, spark.createDataFrame([("y",)], "tag string")).collect()} == {"a", "c"}
    assert [r["id"] for r in filters.keyword_search(df, "ONE， a ,").collect()] == ["a"]
    assert filters.keyword_search(df, " ,").count() == 3
    assert {r["id"] for r in filters.keyword_search_columns(df, "one", ("tags",)).collect()} == {"c"}


def test_order_pages_and_labels(spark):
    df = scored(spark, ROWS)
    assert [r["id"] for r in rank.sort_catalogue(df).collect()] == ["b", "a", "c"]
    assert [r["id"] for r in rank.sort_catalogue(df, ascending=True).collect()] == ["c", "b", "a"]
    assert [r["id"] for r in rank.sort_catalogue(df, "upload_date").collect()] == ["b", "c", "a"]
    pages = [[r["id"] for r in rank.page(df, rank.sort_order(), k, 2).collect()] for k in range(3)]
    assert pages == [["b", "a"], ["c"], []]
    assert [r["label"] for r in rank.page_ranges(df, 2).collect()] == ["0 ~ 1", "2 ~ 2"] and rank.page_ranges(df.limit(0), 2).count() == 0


def test_context(spark):
    df = scored(spark, ROWS)
    text = context.format_context(df).first()[0]
    assert text.startswith(context.HEADING) and text.count("\n") == 4 and "- ID: a | 标题: T | 作者: au | 标签: tag | 评分: 5 | 链接: l\n" in text
    assert context.format_context(df.limit(0)).first()[0] == ""
    drawn = context.sample_context(df, 2, 1).collect()
    assert len(drawn) == 2 and drawn == context.sample_context(df.repartition(3), 2, 1).collect() and context.sample_context(df, -1).count() == 0


def test_split_reasoning(spark):
    cases = {"<think> a </think> b </think> c": ("a", "b"), "Thinking Process: a</think>b": ("a", "b"), "<think>a": ("a", ""), " plain ": ("", " plain "), "x </think> y": ("", "x </think> y"), "": ("", "")}
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    assert {r["m"]: (r["think"], r["answer"]) for r in context.split_reasoning(df, "m").collect()} == cases
