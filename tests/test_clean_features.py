import base64

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import clean, features
from quillon.schema import CATALOGUE, rename_source

WIDE = "　\xa0"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(("value", "want"), [(f"{WIDE}a b\t{WIDE}", "a b"), ("", ""), ("\x1fa\x1c", "a"), (WIDE, "")])
def test_strip_is_unicode(spark, value, want):
    assert one(spark, value, T.strip) == want


def test_text_helpers(spark):
    assert one(spark, "a,,b, ", T.split_raw) == ["a", "", "b", ""]
    assert one(spark, "", T.split_raw) == [] and one(spark, " ", T.split_raw) == [""]
    assert one(spark, f"a,,{WIDE}b,a", T.split_items) == ["a", "b", "a"]
    assert one(spark, "b, a,b", lambda c: T.join_unique(T.split_items(c))) == "b, a"
    assert one(spark, "上架: 2024-01-02 10:00", T.normalise_date) == "2024-01-02" and one(spark, " x ", T.normalise_date) == "x"
    assert one(spark, 'a\\b/c*d?e:f"g<h>i|j', T.sanitise_name) == "a_b_c_d_e_f_g_h_i_j"
    assert one(spark, " HTTPS://x", T.is_web_link) and not one(spark, "ftp://x", T.is_web_link) and not one(spark, None, T.is_web_link)
    assert one(spark, f" A{WIDE}{WIDE}b\n", lambda c: T.search_text(c, F.lit(None), F.lit("C"))) == "a b c"


@pytest.mark.parametrize(("item", "link", "want"), [(" NH7 ", "x", "NH7"), ("", "https://a/g/12/3/", "NH12"), (None, "https://a/album/5", "JM5"), ("", "https://a/", None)])
def test_resolve_id(spark, item, link, want):
    assert spark.createDataFrame([(item, link)], "id string, link string").select(T.resolve_id(F.col("id"), F.col("link"))).first()[0] == want


def test_backfill_keeps_what_is_not_a_digit(spark):
    df = spark.createDataFrame([("", "https://a/g/12/3/"), (None, "https://a/album/9x/"), ("K", "https://a/g/1/"), ("", "https://a/")], "id string, link string")
    assert [r[0] for r in clean.backfill_id_from_link(df).collect()] == ["NH12/3", "JM9x", "K", ""]


def test_normalise_catalogue(spark):
    df = spark.createDataFrame([(2, None, f" https://a/g/1/{WIDE}", "", "file"), (1, "NH1", "https://b", "first", None), (3, "", "x", None, "f3"), (4, None, None, "t", "f4")], "n int, id string, link string, title string, file_name string")
    got = {r["id"]: r for r in clean.normalise_catalogue(df, ["n"]).collect()}
    assert set(got) == {"NH1", ""} and got["NH1"]["title"] == "first" and got[""]["title"] == "f3"
    assert list(got[""].asDict()) == CATALOGUE and got["NH1"]["tags"] == ""
    with pytest.raises(ValueError):
        clean.normalise_catalogue(df.drop("link"), ["n"])


def test_two_forms_of_moving_language_tags(spark):
    df = spark.createDataFrame([("a, 英文,b,英文", "中文"), ("a,,b", "x, x")], "tags string, language string")
    assert [tuple(r) for r in clean.move_language_tags(df).collect()] == [("a, b", "中文, 英文"), ("a, b", "x")]
    assert [tuple(r) for r in clean.move_language_tags(df, clean.TOOL_LANGUAGES, all_rows=False).collect()] == [("a, b", "中文, 英文"), ("a,,b", "x, x")]


def test_covers_and_renaming(spark):
    images = spark.createDataFrame([("/c/NH1.jpg", bytearray(b"x" * 100)), ("/c/NH2.PNG", bytearray(b"y")), ("/c/NH3.txt", bytearray(b"z")), ("/c/NH4.gif", bytearray(b"z"))], "path string, content binary")
    got = dict(clean.encode_covers(images, spark.createDataFrame([("NH4",)], "id string")).collect())
    assert got == {"NH1": "data:image/jpeg;base64," + base64.b64encode(b"x" * 100).decode(), "NH2": "data:image/png;base64,eQ=="}
    assert rename_source(spark.createDataFrame([("1", "t")], "`ID` string, `标题` string")).columns == ["id", "title"]


def test_stop_tags_look_at_raw_tags_and_mapping_follows(spark):
    df = spark.createDataFrame([("1", "a,,b,a"), ("2", " "), ("3", ""), ("4", "x, b")], "id string, tags string")
    stop, maps = {"b"}, {"x": "b", "a": "c"}
    want = {"1": ["c", "", "c"], "2": [""], "3": [], "4": ["b"]}
    assert {r["id"]: r["parsed_tags"] for r in features.parse_tags(df, stop, maps).collect()} == want
    joined = features.parse_tags_joined(df, spark.createDataFrame([("b",)], "term string"), spark.createDataFrame(list(maps.items()), "term string, mapped string"))
    assert {r["id"]: r["parsed_tags"] for r in joined.collect()} == want


def test_titles_with_a_tokenizer_of_the_caller(spark):
    df = spark.createDataFrame([("[Circle] small (x) ring",), (None,)], "title string")
    tokens = features.tokenize_titles(df, lambda t: [(w, "noun" if w != "small" else "particle") for w in t.split()], strip_parens=True)
    assert [r["title_words"] for r in features.title_words(tokens, set(), {"ring": "band"}).collect()] == [["band"], []]
    plain = features.title_words(features.tokenize_titles(df), {"x"}, {})
    assert [r["title_words"] for r in plain.collect()] == [["small", "ring"], []]


def test_feature_counts_keep_repeats(spark):
    df = spark.createDataFrame([("1", ["a", "b", "a"]), ("2", [])], "id string, t array<string>")
    assert sorted((r["feature"], r["cnt"], round(r["norm"], 4)) for r in features.feature_counts(df, "t").collect()) == [("a", 2, 1.7321), ("b", 1, 1.7321)]


def test_disambiguate_map(spark):
    df = spark.createDataFrame([("uniform", "dress", 0), ("school uniform", "dress", 1), ("glasses", "specs", 2)], "term string, mapped string, pos int")
    assert {r["term"]: r["mapped"] for r in features.disambiguate_map(df).collect()} == {"uniform": "dress(uniform)", "school uniform": "dress(uniform)", "glasses": "specs(glasses)"}
