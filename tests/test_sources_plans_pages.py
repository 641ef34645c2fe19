import json

import pytest

from quillon.operators import pages
from quillon.plans import preprocess as plans
from quillon.schema import CATALOGUE, HISTORY, rename_source
from quillon.sources import files


def test_csv_folder_with_all_kinds_of_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿ID,链接,标题,extra\nNH1,https://a/g/1/,"line\nbreak ""q""",x\n,https://a/g/2/,NA,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("标签,链接,标题\n\"a, b\",https://a/g/1/,later\nnull,https://a/album/3/,None\n", encoding="utf-8")
    (tmp_path / "c.txt").write_text("no csv")
    raw = files.read_catalogue_csv(spark, str(tmp_path))
    got = {(r["链接"], r["标题"]): r for r in raw.collect()}
    assert set(got) == {("https://a/g/1/", 'line\nbreak "q"'), ("https://a/g/2/", ""), ("https://a/g/1/", "later"), ("https://a/album/3/", "")}
    done = plans.ingest(rename_source(raw), None).collect()
    assert {r["id"]: r["title"] for r in done} == {"NH1": 'line\nbreak "q"', "NH2": "", "JM3": ""} and list(done[0].asDict()) == CATALOGUE


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.html").write_text('<A HREF="u1" ADD="1">Tom &amp; box&#39;s</A>\nnothing\n<A HREF="u1">last</A> <A HREF="u9">no</A>\n<A HREF="u2">b</A>\n')
    assert sorted(map(tuple, files.read_bookmarks(spark, str(tmp_path / "m.html")).collect())) == [("u1", "last"), ("u2", "b")]
    (tmp_path / "w.txt").write_text("'a', 'full color', \"both\", '', 'x\ny' 'a'")
    assert {"a", "full color", ""} <= {r[0] for r in files.read_word_set(spark, str(tmp_path / "w.txt")).collect()}
    assert "both" in {r[0] for r in files.read_word_set(spark, str(tmp_path / "w.txt"), "both").collect()}
    assert files.read_word_set(spark, str(tmp_path / "missing")).count() == 0 and files.read_semantic_map(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "s.json").write_text('{"b": "1", "a": "2", "b": "3"}')
    assert [tuple(r) for r in files.read_semantic_map(spark, str(tmp_path / "s.json")).orderBy("pos").collect()] == [("b", "3", 0), ("a", "2", 1)]


def test_tables(spark, tmp_path):
    rows = [(i, *["x"] * 9) for i in ("1", "2", "1")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in CATALOGUE))
    with pytest.raises(ValueError):
        files.write_catalogue(df, str(tmp_path / "t"))
    files.write_catalogue(df, str(tmp_path / "t"), ["title"])
    current = spark.read.parquet(str(tmp_path / "t"))
    batch = df.where("id = '2'").withColumns({"title": df.id})
    once = files.upsert_catalogue(current, batch)
    assert sorted(map(str, once.collect())) == sorted(map(str, files.upsert_catalogue(once, batch).collect())) and once.count() == 2


def test_history_file(spark, tmp_path):
    entry = {"opened_at": "2024", "id": "a", "title": "t", "tags": ["x"]}
    (tmp_path / "h.json").write_text(json.dumps([entry, {**entry, "opened_at": "2025"}, {"opened_at": "2026"}]))
    assert [r["opened_at"] for r in files.read_history(spark, str(tmp_path / "h.json"), 5).collect()] == ["2025", "2024"]
    (tmp_path / "bad.json").write_text("{not json")
    assert files.read_history(spark, str(tmp_path / "bad.json")).count() == 0 and files.read_history(spark, str(tmp_path / "none")).count() == 0
    files.write_history(spark.createDataFrame([(str(k), "a", f"i{k}", "t", "", "", "", [], []) for k in range(60)], HISTORY), str(tmp_path / "out"), 50)
    assert files.read_history(spark, str(tmp_path / "out"), 100).count() == 50


def test_failed_pages(spark):
    df = spark.createDataFrame([(0, "[页数: 12, ID: NH1] x"), (1, "no"), (2, "[页数: 3"), (3, "[页数: 12")], "line_no int, value string")
    assert [r["page"] for r in files.failed_pages(df, files.FAILED_PATTERNS[0]).collect()] == [12, 3]
    jm = spark.createDataFrame([(0, "x [第7页 / 总第90个漫画]")], "line_no int, value string")
    assert [r["page"] for r in files.failed_pages(jm, files.FAILED_PATTERNS[1]).collect()] == [7]


def test_fingerprint_sees_count_and_greatest_id(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, t string")
    edited = df.withColumn("t", df.id)
    key = lambda d, **k: plans.fingerprint(d, ("s",), **k).first()[0]
    assert key(df) == key(edited) and key(df, content=True) != key(edited, content=True) and key(df) != key(df.limit(1))
    empty = plans.preprocess(spark.createDataFrame([], ", ".join(f"{c} string" for c in CATALOGUE)), plans.Dictionaries(set(), {}, set(), {}))
    assert empty.items.count() == 0 and empty.freqs.tags.count() == 0


GALLERY = """<h2 class="title"></h2><h1 class="title">x <span class="before">[a]</span><span class="pretty"> Name &amp; b </span></h1>
<div class="tag-container field-name">Tags: <span class="tags"><a><span class="name">t1</span></a><a><span class="name"> t2</span></span></div>
<div class="tag-container field-name">Uploaded: <time datetime="2024-01-02T03:04:05">x</time></div><p>unclosed"""
ALBUM = """<h1 id="book-name"> Book </h1><span itemprop="genre" data-type="tags"><a>a</a><a> </a><a>b</a></span><span itemprop="datePublished">上架: 2023-05-06</span>"""


def test_detail_pages_of_both_layouts(spark):
    df = spark.createDataFrame([(1, "u", GALLERY), (2, "u", None), (3, "u", ALBUM)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pages.extract_fields(df, pages.GALLERY_RULES).collect()}
    assert (got[1]["title"], got[1]["tags"], got[1]["uploaded_date"], got[1]["groups"]) == ("Name & b", "t1, t2", "2024-01-02", "") and got[2]["title"] == ""
    album = {r["page_id"]: r for r in pages.extract_fields(df, pages.ALBUM_RULES).collect()}[3]
    assert (album["title"], album["tags"], album["author"], album["upload_date"]) == ("Book", "a, b", "", "2023-05-06")


def test_list_pages_and_pending_items(spark):
    html = '<div class="gallery big"><a class="cover" href="/g/5/"><img src="s.jpg"></a></div><div class="gallery"><a class="cover" href="/x/6/"></a></div><div class="gallery"><a class="cover" href="/g/7/"></a></div>'
    df = spark.createDataFrame([(1, html), (2, "")], "page_id long, html string")
    found = pages.extract_listing(df, pages.GALLERY_LIST)
    assert [(r["position"], r["id"], r["thumb_url"]) for r in found.orderBy("position").collect()] == [(1, "NH5", "s.jpg"), (3, "NH7", "")]
    none = found.select("id").limit(0)
    five = found.where("id = 'NH5'")
    assert {r["id"]: (r["need_record"], r["need_thumb"]) for r in pages.pending_items(found, five, none).collect()} == {"NH5": (False, True), "NH7": (True, False)}
    assert [r["id"] for r in pages.pending_items(found, five, five).collect()] == ["NH7"]
