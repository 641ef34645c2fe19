from pyspark.sql import functions as F

from quillon.llm import near
from quillon.llm.common import connected_components


def brute(rows, width, percent):
    """component by doc_id, from all pairs of sets."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets.setdefault(doc_id, set()).update({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in ids:
        for j in ids:
            n = len(sets[i] & sets[j])
            if i < j and n and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: root(i) for i in ids}


def test_components_match_all_pairs(documents):
    for width in (4, 5):
        rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
        want = brute(rows, width, 80)
        got = near.near_duplicates(documents, width, 80).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"])
        assert len(set(want.values())) < len(want)


def test_a_large_group_of_near_copies_and_its_neighbours(spark):
    """A chain of texts, each near the next but not near the first, beside a group around one text and a passage that many share."""
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join(base[i:i + 50] + ["x"] * 0) for i in range(0, 10, 2)]
    group = [" ".join([*base[:30], f"g{k}", *[f"v{i}" for i in range(60)]]) for k in range(120)]
    passage = [" ".join([*[f"p{i}" for i in range(20)], *[f"q{k}_{i}" for i in range(30)]]) for k in range(60)]
    rows = list(enumerate([*chain, *group, *passage, *group[:7]]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 5, 80)
    assert {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs, 5, 80).collect()} == want


def test_empty_table(no_documents):
    assert near.near_duplicates(no_documents).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0


def test_rows_of_equal_id_are_one_document(spark):
    rows = [(3, "a b c d e"), (7, "a b c d e"), (7, "x y z w v"), (8, "x y z w v"), (9, "p q r s t"), (None, "x y z w v")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in got) == sorted(map(str, [(3, 3, True), (7, 3, False), (7, 3, False), (8, 3, False), (9, 9, True), (None, None, True)]))
