import numpy as np

from quillon.llm import caps

SCHEMA = "vec_id long, embedding array<float>, label int, id long, n long"


def brute(rows, cosine):
    fine = {}
    for k, (vec_id, e, label) in enumerate(rows):
        if vec_id is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            fine[k] = (vec_id, label, np.array(e, np.float32).astype(float))
    links = [[] for _ in rows]
    for i, (_, a, x) in fine.items():
        links[i] = [j for j, (_, b, y) in fine.items() if i != j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine]
    comp = {r[0]: r[0] for r in rows if r[0] is not None}
    for _ in rows:
        for i, js in enumerate(links):
            for j in js:
                m = min(comp[rows[i][0]], comp[rows[j][0]])
                comp[rows[i][0]] = comp[rows[j][0]] = m
    return [(r[0], len(links[k]), comp.get(r[0])) for k, r in enumerate(rows)]


def test_links_match_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(60):
        c = rng.standard_normal(64)
        for _ in range(rng.integers(1, 6)):
            rows.append([(c + rng.standard_normal(64) * rng.choice([0.05, 0.2, 0.35])).astype(np.float32).tolist(), g % 3])
    rows = [(i, e, label) for i, (e, label) in enumerate(rows)]
    rows += [(900 + i, rows[0][1], 0) for i in range(6)] + [(910, rows[0][1], None), (911, rows[0][1], 1), (912, None, 0), (913, [], 0), (914, [0.0] * 64, 0), (915, [0.0] * 64, 0)]
    rows += [(916, [float("nan")] * 64, 0), (917, [float("nan")] * 64, 0), (918, [None, 1.0], 0), (919, [1.0, 2.0], 0), (920, [2.0, 4.0], 0), (921, [1e38] * 64, 0), (922, [2e38] * 64, 0), (None, rows[0][1], 0)]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = caps.near_vectors(vectors, 0.93).collect()
    assert sorted(map(str, [(r["vec_id"], r["n_links"], r["component_id"]) for r in got])) == sorted(map(str, brute(rows, 0.93)))
    assert caps.near_vectors(vectors.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """Pairs at exactly the least cosine share a direction, for several dimensions and sizes of the largest label."""
    rng = np.random.default_rng(1)
    for dim, pairs, largest in ((16, 300, 5000), (64, 500, 5000), (64, 300, 200), (64, 100, 100_000), (768, 60, 5000)):
        x = rng.standard_normal((pairs, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.standard_normal((pairs, dim))
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = (set(zip(*(v.tolist() for v in caps.directions(side, largest, 0.93)), strict=True)) for side in (x, y))
        assert len({row for row, _ in a & b}) >= 0.99 * pairs, (dim, largest)


def test_decoding_lists_all_directions_beyond_the_threshold():
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((40, 9)), rng.standard_normal((40, 7))
    for threshold in (-9.0, 0.0, 1.5, 3.0, 9.0):
        got = set(zip(*(v.tolist() for v in caps.list_decode(a, b, threshold)), strict=True))
        assert got == {(r, i * 7 + j) for r in range(40) for i in range(9) for j in range(7) if b[r, j] >= threshold - a[r, i]}


def test_crowded_directions_count_each_link_once(spark, monkeypatch):
    """Large groups of near vectors, with chunks so small that many tiles meet, some pairs crowded and some not."""
    monkeypatch.setattr(caps, "CROWD", 6)
    monkeypatch.setattr(caps, "TILE", 8)
    rng = np.random.default_rng(6)
    rows = []
    for g in range(12):
        c = rng.standard_normal(32)
        rows += [(1000 * g + k, (c + rng.standard_normal(32) * rng.choice([0.02, 0.25, 0.4])).astype(np.float32).tolist(), g % 2) for k in range(60 if g < 2 else 7)]
    rows += [(5, rows[0][1], 0), (6, rows[0][1], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = caps.near_vectors(vectors, 0.93).collect()
    want = brute(rows, 0.93)
    assert sorted((r["vec_id"], r["component_id"]) for r in got) == sorted((i, c) for i, _, c in want)
    assert sum(abs(x - y) for x, y in zip(sorted(r["n_links"] for r in got), sorted(n for _, n, _ in want), strict=True)) <= 0.01 * sum(n for _, n, _ in want)
    assert max(r["n_links"] for r in got) > 30


def test_rows_of_equal_id_share_a_component(spark):
    a, b, c = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5], [1.0, -1.0, 4.0]
    rows = [(3, a, 0), (7, a, 0), (7, b, 0), (7, c, 1), (9, c, 1), (12, b, 1)]
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(3, 1, 3), (7, 0, 3), (7, 1, 3), (7, 1, 3), (9, 1, 3), (12, 0, 12)]
