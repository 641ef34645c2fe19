import random

import numpy as np
import pytest

from quillon.llm import factors


def brute(rows):
    """(n_words, n_removed, kept) of each row (doc_id, text), from all windows of all rows."""
    order = [factors.LAST if i is None else i for i, _ in rows]
    own = [(t or "").encode().split() for _, t in rows]
    first = {}
    for i, w in zip(order, own, strict=True):
        for k in range(len(w) - 49):
            key = tuple(w[k:k + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in zip(order, own, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k:k + 50])] < i:
                gone[k:k + 50] = [True] * 50
        out.append((len(w), sum(gone), b" ".join([x for x, g in zip(w, gone, strict=True) if not g]).decode()))
    return out


def check(spark, rows):
    got = factors.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept"])) for r in got) == sorted(str((i, *w)) for (i, _), w in zip(rows, want, strict=True))
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
    return sum(w[1] for w in want)


def test_documents_as_by_brute_force(documents):
    """Nulls, empty and long texts, copies, repeated rows, rows without id, columns of clashing names."""
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = factors.remove_repeats(documents).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept"])) for r in got) == sorted(str((i, *w)) for (i, _), w in zip(rows, brute(rows), strict=True))


def text(rng, n, some=2000):
    return [f"w{rng.randrange(some)}" for _ in range(n)]


@pytest.mark.parametrize("some", [2, 2000])
def test_passages_in_other_surroundings(spark, some):
    """Passages shared in part, with other words at either end, of just under, just and over 50 words; with two words only, texts repeat themselves everywhere."""
    rng = random.Random(some)
    passages = [text(rng, n, some) for n in (49, 50, 51, 75, 99, 100, 150, 300)]
    rows = []
    for k in range(80):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(0, 30)
            parts += text(rng, rng.choice([0, 1, 30, 80]), some) + p[a:a + rng.choice([48, 49, 50, 51, 60, 400])]
        rows.append((rng.choice([k, k, k % 20, None]), " ".join(parts)))
    assert check(spark, rows) > 1000


def test_one_passage_with_many_edges(spark):
    """Groups within a group: some of the texts around a passage agree with each other further than with the first one."""
    rng = random.Random(6)
    passage, rows = text(rng, 60), []
    ends = [text(rng, 40) for _ in range(4)]
    for k in range(150):
        e = ends[k % 4]
        rows.append((k, " ".join(e[: rng.randrange(41)][::-1][::-1] + passage + ends[(k // 4) % 4][: rng.randrange(41)] + text(rng, rng.randrange(40)))))
    rows += [(1000 + k, " ".join(e[-rng.randrange(1, 41):] + passage[: rng.randrange(25, 61)] + text(rng, 30))) for k in range(100) for e in [ends[k % 4]]]
    assert check(spark, rows) > 1000


def test_a_word_repeated(spark):
    rows = [(3, "long " * 5000), (2, "long " * 49), (5, "long " * 50), (1, "a " + "long " * 49), (4, "b " + "Long " * 70), (6, "b " + "Long " * 60)]
    assert check(spark, rows) == 50 + 61


def test_equal_ids_and_rows(spark):
    rng = random.Random(3)
    a, b = (" ".join(text(rng, 80)) for _ in range(2))
    rows = [(7, a), (7, a), (7, a + " more"), (9, a), (None, a), (None, b), (None, b), (None, b + " x"), (8, None), (8, ""), (8, " \n\t ")]
    check(spark, rows)


def test_every_window_has_an_anchor():
    rng = np.random.default_rng(1)
    for n in (26, 27, 60, 400):
        spans = rng.integers(0, 5, n).astype(np.uint64)
        at, first, last = factors.anchors(spans)
        windows = [w for f, x in zip(first, last, strict=True) for w in range(f, x + 1)]
        assert windows == list(range(n - 25)) and len(set(at.tolist())) == len(at)
        for a, f, x in zip(at, first, last, strict=True):
            for w in range(f, x + 1):
                assert a == w + int(np.argmin(spans[w:w + 26]))
    assert len(factors.anchors(spans[:25])[0]) == 0


def test_span_hashes_do_not_depend_on_the_place():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    h[100:150] = h[200:250]
    found = factors.span_hashes(h, 25)
    assert (found[100:126] == found[200:226]).all() and len(np.unique(found)) == len(found) - 26


def test_empty_table(no_documents):
    assert factors.remove_repeats(no_documents).count() == 0
