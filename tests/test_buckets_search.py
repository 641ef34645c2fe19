import random

from pyspark.sql import functions as F

from quillon.operators import filters, search
from quillon.schema import CATALOGUE
from quillon.sources import buckets, files
from quillon.streaming.history import read_state, stream_history


def table(spark, rows):
    return spark.createDataFrame([(i, t, *[""] * (len(CATALOGUE) - 2)) for i, t in rows], ", ".join(f"{c} string" for c in ["id", "title", *[c for c in CATALOGUE if c not in ("id", "title")]]))


def content(df):
    return sorted((str(r["id"]), r["title"]) for r in df.select("id", "title").collect())


def data_files(path):
    return {str(p.relative_to(path)) for p in (path / "data").rglob("*.parquet")}


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    path, plain = f"file://{tmp_path}", tmp_path
    first = table(spark, [(f"i{k}", "old") for k in range(200)] + [(None, "old"), ("", "old")])
    files.upsert_buckets(first, path, number=16)
    before = data_files(plain)
    batch = table(spark, [("i3", "new"), ("i3", "newer"), ("x", "new")])
    files.upsert_buckets(batch, path)
    assert content(files.read_buckets(spark, path)) == content(files.upsert_catalogue(first, batch))
    wanted = {r[0] for r in batch.select(buckets.bucket_of("id", 16)).distinct().collect()}
    added = data_files(plain) - before
    assert before <= data_files(plain) and {int(f.split("_bucket=")[1].split("/")[0]) for f in added} == wanted
    kept = buckets._manifest(spark, path, 1)[0]
    assert all(("/000000000000/" in f) == (k not in wanted) for k, f in kept.items())
    buckets.vacuum(spark, path, 1)
    assert content(files.read_buckets(spark, path)) == content(files.upsert_catalogue(first, batch)) and buckets.versions(spark, path) == [1]
    files.upsert_buckets(batch.limit(0), path)
    assert content(files.read_buckets(spark, path)) == content(files.upsert_catalogue(first, batch))


def test_a_merge_that_broke_off_is_not_seen_and_can_run_again(spark, tmp_path):
    path = f"file://{tmp_path}"
    assert buckets.read(spark, path) is None and files.read_buckets(spark, path).count() == 0
    files.upsert_buckets(table(spark, [("a", "1"), ("b", "1")]), path, number=4)
    files.upsert_buckets(table(spark, [("a", "2")]), path)
    (tmp_path / "manifest" / f"{1:012d}" / "_SUCCESS").unlink()
    assert content(files.read_buckets(spark, path)) == [("a", "1"), ("b", "1")]
    files.upsert_buckets(table(spark, [("b", "3")]), path)
    assert content(files.read_buckets(spark, path)) == [("a", "1"), ("b", "3")] and buckets.versions(spark, path) == [0, 1]


def test_a_batch_of_opens_writes_its_own_keys(spark, tmp_path):
    items = spark.createDataFrame([("A", "t", "au", "l", "p", ["x"], ["w"])], "id string, title string, author string, link string, local_path string, parsed_tags array<string>, title_words array<string>")
    schema, source, state = "opened_at string, action string, id string, user_id long, event_id long", tmp_path / "in", tmp_path / "state"
    rng = random.Random(1)
    rows = [(f"2024-01-01T00:00:{k:02d}", "network_link", "A", rng.randrange(40), k) for k in range(60)]

    def take(some):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema(schema).parquet(f"file://{source}")
        stream_history(stream, items, f"file://{state}", f"file://{tmp_path}/marks", 2, "user_id", ("event_id",), parts=32).awaitTermination()

    def names():
        return {p.name for p in (state / "data").rglob("*.parquet")}

    take(rows[:50])
    before = names()
    take([(*rows[50][:3], 7, 50)])
    assert len(names() - before) == 1, "one key's open writes one bucket"
    want = {}
    for r in sorted([*rows[:50], (*rows[50][:3], 7, 50)], key=lambda r: r[0], reverse=True):
        want.setdefault(r[3], []).append(r[4])
    got = {}
    for r in read_state(spark, f"file://{state}").collect():
        got.setdefault(r["user_id"], []).append(r["event_id"])
    assert {u: sorted(e, reverse=True) for u, e in got.items()} == {u: e[:2] for u, e in want.items()}
    for k in range(51, 54):
        take([(*rows[k][:3], 7, k)])
    assert len(list((state / "manifest").iterdir())) == 2, "older versions go"


def test_keyword_search_reads_the_blocks_that_can_hold_the_terms(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "abcd" for b in "efgh" for c in "ijkl"]
    rows = [(f"i{k}", w := words[k // 20], f"{w} {rng.choice(words[:8])} é{k % 7}") for k in range(1200)] + [("short", "z", "zz"), ("none", "z", "")]
    items = spark.createDataFrame(rows, "id string, author string, search_text string").withColumn("title", F.lit(""))
    index = search.store_search(items, rows=60)
    every = index.rows.select("_block").distinct().count()
    assert every > 10
    for query in ("dhl", "BFJ, é3", "aei， aei dd", "zz", "k", "nothing", " ,", "el é", "aei, nothing"):
        want = sorted(r["id"] for r in filters.keyword_search(items, query).collect())
        assert sorted(r["id"] for r in index.search(query).collect()) == want, query
        blocks = index.blocks(query)
        if query in ("dhl", "BFJ, é3", "nothing"):
            assert blocks.count() <= every // 3
    assert index.search("dhl").columns == items.columns
    assert search.store_search(items.limit(0)).search("abc").count() == 0
