"""How many pairs meet in the close match, beside that its results are difflib's (test_matching)."""

import difflib

import pytest
from pyspark.sql import functions as F

from quillon.adapters import DICTIONARIES, small_catalogue
from quillon.operators import matching
from quillon.plans import preprocess as plans
from quillon.schema import NO_FOLDER
from quillon.sources import files


@pytest.fixture
def met(monkeypatch):
    """The likeness asked for and the number of pairs that difflib or its bounds see, for each call."""
    found, likeness = [], matching.likeness
    monkeypatch.setattr(matching, "likeness", lambda pairs, cutoff: (found.append((cutoff, pairs.count())), likeness(pairs, cutoff))[1])
    return found


def folders_of(df):
    return df.select(F.col("name").alias("folder_name"), F.concat(F.lit("/"), "name").alias("path"), F.col("id").alias("pos"))


def test_names_of_foreign_characters_meet_no_folder(spark, monkeypatch):
    """The preprocessing query's case: digits are all that a name shares with a folder, and too few of them for any length of folder."""
    joined, count = [], matching.candidates
    monkeypatch.setattr(matching, "candidates", lambda *a, **b: (joined.append(out := count(*a, **b)), out)[1])
    items = spark.range(1000, 1300).select("id", F.concat(F.lit("無無無無無無"), "id").alias("file_name"))
    folders = folders_of(spark.range(1000, 1300).select("id", F.concat(F.lit("brass gear "), "id").alias("name")))
    assert {r[0] for r in matching.match_close(items, folders).select("local_path").distinct().collect()} == {NO_FOLDER}
    names, known = items.select(F.col("file_name").alias("name")), folders.select(F.col("folder_name").alias("name"))
    # four digits are too few for a folder of any length, so a name has no element to meet one by
    assert matching._placed(matching.with_elements(names, matching.pair_ranks(names, known)), 0.6).count() == 0
    assert len(joined) == 3 and all(j.count() == 0 for j in joined)


def test_a_name_with_a_very_like_folder_meets_no_others_below(spark, met):
    """All names are alike by 0.6 or more, yet each has a folder of its own at 0.9, and only one of another kind goes on."""
    names = spark.range(100, 400).select("id", F.format_string("%s-shared-title-%s", F.md5(F.col("id").cast("string")), F.col("id")).alias("name"))
    items = names.select("id", F.concat("name", F.lit("+")).alias("file_name")).unionByName(spark.createDataFrame([(1, "xyzxyz w")], "id long, file_name string"))
    folders = folders_of(names.unionByName(spark.createDataFrame([(1, "xyzxyz")], "id long, name string")))
    got = {r["id"]: r["local_path"] for r in matching.match_close(items, folders).collect()}
    known = [r[0] for r in folders.select("folder_name").collect()]
    asked = {r["id"]: r["file_name"] for r in items.collect()}
    for i in (1, 100, 250, 399):
        assert got[i] == "/" + difflib.get_close_matches(asked[i], known, 1, 0.6)[0]
    assert [c for c, _ in met] == [0.9, 0.75] or [c for c, _ in met] == [0.9, 0.75, 0.6]
    assert sum(n for _, n in met) < 0.1 * 301 * 301


def test_the_greatest_likeness_is_found_at_every_step(spark):
    words = ["abcdefghij", "abcdefghix", "abcdefg", "abcde", "abcd", "zzzzabcdef", "q"]
    folders = folders_of(spark.createDataFrame(list(enumerate(words)), "id long, name string"))
    asked = ["abcdefghiz", "abcdefgh", "abcdef", "abc", "ab", "zzabcdef", "qq", "qz", "abcdefghijk", "kjihgfedcba"]
    got = matching.match_close(spark.createDataFrame([(a,) for a in asked], "file_name string"), folders).collect()
    for r in got:
        close = difflib.get_close_matches(r["file_name"], words, 1, 0.6)
        assert r["local_path"] == ("/" + close[0] if close else NO_FOLDER), r["file_name"]


def test_hot_elements_are_dealt_out_and_nothing_is_lost(spark):
    names = spark.range(60).select(F.concat(F.lit("aaaa"), F.col("id").cast("string")).alias("name"))
    held = matching.with_elements(names, matching.pair_ranks(names, names))
    other = held.withColumnRenamed("name", "folder")
    one, many = ({(r["name"], r["folder"]) for r in matching.candidates(held, other, 0.6, salts).collect()} for salts in (1, 8))
    texts = [r[0] for r in names.collect()]
    assert one == many >= {(a, b) for a in texts for b in texts if difflib.SequenceMatcher(None, b, a).ratio() >= 0.6}


def test_stored_features_match_no_name_by_its_digits(spark, met, monkeypatch):
    """As in the stored query: a third of the names are like no folder, and none of their elements meets one; a second call matches nothing anew."""
    asked, call = [], matching.candidates
    monkeypatch.setattr(matching, "candidates", lambda names, *a, **b: (asked.append((names, a[1])), call(names, *a, **b))[1])
    df = small_catalogue(spark, "/root/testdata/sf0.001").withColumn("n", F.regexp_extract("link", r"(\d+)/$", 1).cast("long"))
    df = df.withColumn("file_name", F.when(F.col("n") % 3 == 0, F.concat(F.lit("無無無無無無"), F.col("n") + 1000)).otherwise(F.col("file_name")))
    folders = df.where("n % 3 <> 0").select(F.col("file_name").alias("folder_name"), F.concat(F.lit("/f/"), "n").alias("path"), F.col("n").alias("pos"))
    folder = files.scratch(spark, "prepared")
    first = plans.preprocess_stored(df.drop("n"), DICTIONARIES, folder, folders).items
    assert met and sum(n for _, n in met) == 0 and first.where(F.col("local_path") == NO_FOLDER).count() == df.where("n % 3 = 0").count()
    assert [c for _, c in asked] == [0.9, 0.75, 0.6] and all(matching._placed(names, c).count() == 0 for names, c in asked)
    calls = len(met)
    again = plans.preprocess_stored(df.drop("n"), DICTIONARIES, folder, folders).items
    assert len(met) == calls and again.count() == first.count()


def test_the_titles_query_asks_for_high_likeness_first(spark, met):
    """Few titles go on to the query's own cutoff."""
    from quillon import registry

    got = registry.QUERIES["j02_match_close"](spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    (first, _), *rest = met
    assert first == 0.9 and all(n < 4 * 200 for _, n in rest)
