import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import history, matching, vectors
from quillon.schema import NO_FOLDER
from quillon.streaming.history import read_state, stream_history


def frame(spark, rows, dim=8):
    return spark.createDataFrame(rows, "id string, embedding array<float>")


def test_semantic_topk_is_the_full_ranking(spark):
    rng = np.random.default_rng(1)
    rows = [(f"v{i}", rng.standard_normal(8).tolist()) for i in range(50)] + [("zero", [0.0] * 8), ("short", [1.0]), ("none", None)]
    query = rng.standard_normal(8).tolist()
    items = spark.createDataFrame([(r[0],) for r in rows if r[0] != "v3"] + [("no vector",)], "id string")
    got = [(r["id"], round(r["semantic_score"], 3)) for r in vectors.semantic_topk(items, frame(spark, rows), query, 500).collect()]
    q = np.array(query)
    want = sorted(((i, 100 * float(np.float32(v).astype(float) @ q / max(np.linalg.norm(np.float32(v)), 1e-12) / np.linalg.norm(q))) for i, v in rows if v and len(v) == 8 and i != "v3"), key=lambda x: (-x[1], x[0]))
    assert got == [(i, round(s, 3)) for i, s in want]
    assert [x[0] for x in got[:5]] == [r["id"] for r in vectors.semantic_topk(items, frame(spark, rows), query, 5).collect()]


def test_item_vectors_and_cover_topk(spark):
    images = spark.createDataFrame([(" A ", [3.0, 0.0]), ("A", [0.0, 1.0]), ("", [1.0, 0.0]), ("b", [1.0, 0.0]), ("C", [1.0, 0.0])], "item_id string, embedding array<float>")
    vecs = vectors.item_vectors(images)
    got = {r["item_id"]: [round(x, 4) for x in r["embedding"]] for r in vecs.collect()}
    assert got == {"A": [0.7071, 0.7071], "b": [1.0, 0.0], "C": [1.0, 0.0]}
    best = vectors.cover_topk(vecs, " c ", k=0).collect()
    assert [(r["rank"], r["id"], round(r["cover_score"])) for r in best] == [(1, "C", 100)]
    candidates = spark.createDataFrame([(" a",), ("a",), ("b",)], "id string")
    assert [r["id"] for r in vectors.cover_topk(vecs, "C", candidates=candidates).collect()] == ["A"]
    with pytest.raises(ValueError):
        vectors.cover_topk(vecs, "b")


def test_refreshing_twice_encodes_nothing(spark):
    seen = spark.sparkContext.accumulator(0)

    def encoder(values):
        seen.add(len(values))
        return np.ones((len(values), 4))

    schema = "path string, source string, name string, item_id string, size long, mtime_ns long, content string"
    first = spark.createDataFrame([(f"/{i}", "s", "n", "i", 1, 1, None if i == 9 else "x") for i in range(10)], schema)
    index = vectors.refresh_index(None, first, encoder, "m").collect()
    assert len(index) == 9 and seen.value == 9
    stored = spark.createDataFrame(index, "path string, source string, name string, item_id string, size long, mtime_ns long, embedding array<float>")
    second = first.where("path NOT IN ('/1', '/9')").withColumn("size", F.when(F.col("path") == "/2", 5).otherwise(F.col("size")))
    diff = {r["path"]: r["status"] for r in vectors.index_diff(stored, second).collect()}
    assert diff["/1"] == "deleted" and diff["/2"] == "add_or_update" and diff["/3"] == "unchanged"
    assert len(vectors.refresh_index(stored, second, encoder, "m", "m").collect()) == 8 and seen.value == 10
    assert len(vectors.refresh_index(stored, first.where("path <> '/9'"), encoder, "m", "m").collect()) == 9 and seen.value == 10
    assert len(vectors.refresh_index(stored, second, encoder, "new", "m").collect()) == 8 and seen.value == 18
    with pytest.raises(ValueError):
        vectors.refresh_index(stored, second.limit(0), encoder, "m", "m")


def test_match_close_is_difflib(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(2, 14))).strip() or "a" for _ in range(60)]
    folders = [(w, f"/p/{k}", k) for k, w in enumerate(words)] + [("long " * 50, "/p/long", 99), (words[0], "/p/later", 100)]
    names = [w[1:] + rng.choice("xyz") for w in words] + [words[0], words[5] + "?", "", None, "zzzzzzzz", "long " * 49 + "x", "q"]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "k int, file_name string")
    got = {r["k"]: r["local_path"] for r in matching.match_close(items, spark.createDataFrame(folders, "folder_name string, path string, pos int")).collect()}
    paths = {name: path for name, path, _ in folders}
    for i, n in enumerate(names):
        n = (n or "").replace("?", "_")
        close = [n] if n in paths else difflib.get_close_matches(n, list(paths), n=1, cutoff=0.6) if n else []
        assert got[i] == (paths[close[0]] if close else NO_FOLDER), n


ITEMS = "id string, title string, author string, link string, local_path string, parsed_tags array<string>, title_words string"
SHELF = [("NH1", " T1 ", "ann", "https://a/g/1/", "", ["x", "", "y", "x"], "a, b,a"), ("", "T2", "", "bad", "/p", None, None), ("NH3", "T3", "bo", "https://a/g/3/", "", [], "")]


def test_history_entries_and_counts(spark):
    items = spark.createDataFrame(SHELF, ITEMS)
    opens = spark.createDataFrame([("2024-01-01T00:00:0%dZ" % k, "network_link", i) for k, i in enumerate(["NH1", "NH3", "NH1", "none"])], "opened_at string, action string, id string")
    entries = history.history_entries(opens, items)
    got = sorted(entries.collect())
    assert len(got) == 3 and got[0]["title"] == "T1" and got[0]["tags"] == ["x", "y"] and got[0]["title_words"] == ["a", "b"]
    assert sorted((r["facet"], r["feature"], r["n"]) for r in history.history_counts(entries).collect()) == [("author", "ann", 2), ("author", "bo", 1), ("tag", "x", 2), ("tag", "y", 2), ("title_word", "a", 2), ("title_word", "b", 2)]
    assert [r["opened_at"][-2] for r in history.last_n(entries, 2).collect()] == ["2", "1"] and history.last_n(entries, 0).count() == 0
    assert history.last_n(entries, 1, "id").count() == 2


def test_click_log(spark):
    items = spark.createDataFrame(SHELF, ITEMS)
    token = items.where("id = ''").select(history.item_token(items)).first()[0]
    rows = [("1", "/open?token=NH1&target=https%3A%2F%2Ft%2F%3Fa%3Db+c"), ("2", "/open?token=NH1&target=ftp%3A%2F%2Fx"), ("3", f"/open?token={token}&target="), ("4", "/open?token=zz&target="), ("5", "/else?token=NH1"), ("6", "/open?token=a b"), ("7", "/open?token=NH3&target=%zz")]
    got = {r["opened_at"]: r for r in history.click_log_entries(spark.createDataFrame(rows, "opened_at string, path string"), items).collect()}
    assert set(got) == {"1", "2", "3", "4", "6", "7"} and not got["6"]["known"]
    assert [got[k]["known"] for k in "12347"] == [True, True, True, False, True]
    assert [got[k]["redirect"] for k in "12347"] == ["https://t/?a=b c", "https://a/g/1/", None, None, "https://a/g/3/"]


def test_stream_with_a_restart_equals_the_batch(spark, tmp_path):
    items = spark.createDataFrame([(f"I{k}", f"T{k}", "a", "l", "", ["t"], "w") for k in range(20)], ITEMS)
    rng = random.Random(5)
    rows = [(f"2024-01-01T{rng.randrange(24):02}:{k % 60:02}:{k // 60:02}", "network_link", f"I{rng.randrange(22)}", rng.randrange(4), k) for k in range(200)]
    schema = "opened_at string, action string, id string, user long, n long"
    source, state, marks = (str(tmp_path / x) for x in ("in", "state", "marks"))
    parts = [rows[:70], rows[70:120], rows[120:]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        if k != 1:  # the second and third files come after a restart, one micro batch each
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            stream_history(stream, items, state, marks, 5, "user", ("n",)).awaitTermination()
    entries = history.history_entries(spark.createDataFrame(rows, schema), items, ("user", "n"))
    want = sorted((r["user"], r["n"]) for r in history.last_n(entries, 5, "user", ("n",)).collect())
    assert sorted((r["user"], r["n"]) for r in read_state(spark, state).collect()) == want and len(want) == 20
