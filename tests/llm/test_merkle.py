import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, proof of each leaf as a list of digests) by the definition."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 8 * 8
            paths[i] += [x for j, x in enumerate(nodes[run:run + 8], run) if j != k]
            at[i] = k // 8
        nodes = [h("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, lang, leaf), sorted."""
    by = {}
    for doc_id, lang, leaf in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        by.setdefault("" if lang is None else "=" + lang, []).append((doc_id, leaf))
    names = sorted(by, key=str.encode)
    trees = {n: tree([x[1] for x in by[n]]) for n in names}
    root, tops = tree([trees[n][0] for n in names])
    return sorted(str((doc_id, leaf, trees[n][0], root, "".join(path + top))) for n, top in zip(names, tops, strict=True) for (doc_id, leaf), path in zip(by[n], trees[n][1], strict=True))


def proved(df):
    return sorted(str((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"])) for r in df.collect())


def test_documents_by_their_definition(documents):
    """Nulls in every column, empty and long texts, repeated rows, rows of equal id, columns of clashing names."""
    rows = documents.select("doc_id", "lang", merkle.document_leaf().alias("leaf"), F.col("clash").alias("digest"))
    want = [(r["doc_id"], r["lang"], plain_leaf(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])) for r in documents.collect()]
    checked = merkle.verify(merkle.proofs(merkle.manifest(rows)), "leaf")
    assert proved(checked) == brute(want)
    assert checked.where("NOT verified").count() == 0


@pytest.mark.parametrize("sizes", [[1], [8, 1], [9, 64, 65, 513, 1], [4097, 2], [3] * 70])
def test_trees_of_many_shapes(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 100)
    rows = [(k, f"l{t}", h(f"{t}.{k}")) for t, n in enumerate(sizes) for k in range(n)]
    random.Random(1).shuffle(rows)
    made = merkle.manifest(spark.createDataFrame(rows, "doc_id long, lang string, leaf string"))
    assert proved(merkle.proofs(made)) == brute(rows)
    assert made.root().count() == 1


def test_some_leaves_and_tampering(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 50)
    rows = [(k, "en" if k % 3 else None, h(str(k)), h("x") if k % 5 == 0 else h(str(k))) for k in range(700)]
    made = merkle.manifest(spark.createDataFrame(rows, "doc_id long, lang string, leaf string, offered string"))
    some = merkle.proofs(made, made.leaves.where("doc_id % 7 = 2"))
    want = [x for x in brute([r[:3] for r in rows]) if int(x[1:].split(",")[0]) % 7 == 2]
    assert proved(some) == want
    got = {r["doc_id"]: r["verified"] for r in merkle.verify(some, "offered").collect()}
    assert got == {k: k % 5 != 0 for k in range(2, 700, 7)}


def test_a_partition_fetches_each_node_once():
    """All leaves of a tree lack nothing; a range lacks the siblings at its ends only."""
    import numpy as np

    assert sum(len(lack) for _, _, lack, _ in merkle._climb(np.arange(1000), 1000)) == 0
    lacked = [(level, i) for level, _, lack, _ in merkle._climb(np.arange(100, 300), 1000) for i in lack.tolist()]
    assert len(lacked) == len(set(lacked)) <= 14 * 4


def test_repeated_rows_of_one_key_spread_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 20)
    rows = [(5, "en", h("same"))] * 300 + [(None, None, h("n"))] * 40
    made = merkle.manifest(spark.createDataFrame(rows, "doc_id long, lang string, leaf string"))
    assert made.leaves.select("part").distinct().count() > 4
    assert proved(merkle.proofs(made)) == brute(rows)


def test_empty_table(no_documents):
    made = merkle.manifest(no_documents.select("doc_id", "lang", merkle.document_leaf().alias("leaf")))
    assert merkle.verify(merkle.proofs(made), "leaf").count() == 0 and made.root().count() == 0


def test_the_query_tampers_by_crc(spark):
    from quillon.llm.queries import op12_merkle_manifest

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op12_merkle_manifest(spark, "/root/testdata/sf0.001").collect():
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and texts[r["doc_id"]].encode() != texts[r["doc_id"]].encode().lower()
        assert r["verified"] != changed
