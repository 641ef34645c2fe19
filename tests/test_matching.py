import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import matching
from quillon.schema import NO_FOLDER

LATIN = "abcdefghijklmnop rstu"
RICH = "".join(chr(0x4E00 + k) for k in range(2500)) + "ab "


def draw(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n)).strip()


def change(rng, letters, name, edits):
    own = list(name)
    for _ in range(edits):
        k = rng.randrange(len(own) + 1)
        own[k:k + rng.randrange(3)] = draw(rng, letters, rng.randrange(3))
    return "".join(own)


def made(rng, letters, n):
    folders = [draw(rng, letters, rng.randrange(1, 30)) for _ in range(n)]
    names = [change(rng, letters, rng.choice(folders), rng.randrange(9)) for _ in range(n)] + [draw(rng, letters, rng.randrange(1, 30)) for _ in range(n // 4)]
    return names, folders


@pytest.mark.parametrize(("letters", "n"), [(LATIN, 90), (RICH, 150), ("ab", 25)])
@pytest.mark.parametrize("cutoff", [0.6, 0.85])
def test_matches_are_difflibs(spark, letters, n, cutoff):
    rng = random.Random(n)
    names, folders = made(rng, letters, n)
    names += ["", " ", "x" * 300, folders[0] * 20]
    folders += ["x" * 250, "x" * 260 + "y", "y" * 5, ""]
    items = spark.createDataFrame(list(enumerate(names)), "n long, file_name string")
    got = matching.match_close(items, spark.createDataFrame([(f, f"/{k}/{f}", k) for k, f in enumerate(folders)], "folder_name string, path string, pos long"), cutoff)
    paths = {f: f"/{k}/{f}" for k, f in enumerate(folders)}
    known = [f for f in paths if f]
    for r in got.collect():
        name = names[r["n"]]
        close = difflib.get_close_matches(name, known, 1, cutoff) if name else []
        assert r["local_path"] == (paths.get(name) if name and name in paths else paths[close[0]] if close else NO_FOLDER), name
    assert got.count() == len(names)


def test_few_pairs_meet_where_characters_are_many(spark):
    rng = random.Random(1)
    names, folders = (sorted({x for x in xs if x}) for xs in made(rng, RICH, 400))
    tables = [spark.createDataFrame([(x,) for x in xs], "name string") for xs in (names, folders)]
    ranks = matching.character_ranks(tables[0].unionByName(tables[1]))
    left, right = matching.with_elements(tables[0], ranks), matching.with_elements(tables[1], ranks).withColumnRenamed("name", "folder")
    met = matching.candidates(left, right, 0.6).collect()
    assert len({(r["name"], r["folder"]) for r in met}) == len(met) < 0.02 * len(names) * len(folders)
    able = {(r["name"], r["folder"]) for r in met if 2.0 * r["common"] / (r["n"] + r["m"]) >= 0.6}
    close = {(n, f) for n in names for f in folders if difflib.SequenceMatcher(None, f, n).ratio() >= 0.6}
    assert close <= able and len(close) > 100


def test_elements_are_a_multiset_rarest_first(spark):
    df = spark.createDataFrame([("abab",), ("aa",), ("",)], "name string")
    ranks = matching.character_ranks(df)
    assert ranks == {"a": 2, "b": 1}
    got = {r["name"]: [(chr(e >> 32), e & 0xFFFFFFFF) for e in r["elements"]] for r in matching.with_elements(df, ranks).collect()}
    assert got["abab"] == [("b", 2), ("a", 2), ("b", 1), ("a", 1)] and got["aa"] == [("a", 2), ("a", 1)] and got[""] == []


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (draw(rng, "abc", rng.randrange(12)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        places = {}
        for k, c in enumerate(b):
            places[c] = places.get(c, 0) | 1 << k
        assert matching._subsequence(a, places, len(b)) == best[-1][-1]


def test_no_folders_and_no_items(spark):
    items = spark.createDataFrame([("a", "x"), ("b", None)], "id string, file_name string")
    none = spark.createDataFrame([], "folder_name string, path string, pos long")
    assert [r["local_path"] for r in matching.match_close(items, none).collect()] == [NO_FOLDER] * 2
    assert matching.match_close(items.limit(0), none.unionByName(items.select(F.col("id").alias("folder_name"), "file_name", F.lit(1).cast("long").alias("pos")).toDF("folder_name", "path", "pos"))).count() == 0
