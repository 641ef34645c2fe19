"""Embedding near-duplicates by spherical-cap filters.

Each of CODES independent rotations cuts a vector into BLOCKS blocks; each block has its own few random unit codes, and a filter direction is one code of each
block, joined. The vector's product with a direction is the sum of its products with the codes, so that all directions
beyond a threshold are list-decoded from sorted half sums without going through all of them. Vectors that share a direction (and a label) are candidates;
their cosine is then computed in double precision. Of a direction that few vectors exceed the pairs are listed; a crowded one is cut into tiles, in which
links are counted by matrix products, each link once, so that a large group of near vectors never becomes rows of pairs.

The number of directions grows with the largest label so that a direction holds about one unrelated vector, and the threshold is set so that two
vectors at the least cosine share MEETINGS directions on average. How many a vector exceeds differs much within one product code, as its blocks may lie far from all
their codes; over several independent codes that evens out, so that hardly any pair shares none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import connected_components, slices, written

BLOCKS, CODES = 2, 16
MEETINGS = 30.0
#: Below this dimension a block is the whole vector, and directions are no more than for a thousand vectors.
NARROW = 16
_SEED = 7
#: Random vectors that a threshold is read off.
PROBES = 200
#: Vectors of a direction beyond which its links are counted in tiles of two chunks of about TILE vectors; up to it pairs are listed.
CROWD, TILE = 48, 512


def _meeting_chance(z: float, cosine: float) -> float:
    """Chance that a vector lies beyond z standard deviations if one at this cosine does."""
    nd, rest = NormalDist(), math.sqrt(1 - cosine * cosine)
    xs = np.linspace(z, z + 6, 2000)
    p = np.array([nd.pdf(x) for x in xs])
    q = np.array([1 - nd.cdf((z - cosine * x) / rest) for x in xs])
    return float((p * q).sum() / p.sum())


@lru_cache(maxsize=8)
def design(dim: int, largest: int, cosine: float) -> list[tuple[np.ndarray, list[np.ndarray], float]]:
    """(rotation, codes of each block, threshold) of each product code, for vectors of a dimension of which the largest label has so many."""
    density = min(0.02, max(1.0 / max(2, largest), 0.0 if dim >= NARROW else 0.001))
    z = NormalDist().inv_cdf(1 - density)
    directions = MEETINGS / CODES / _meeting_chance(z, cosine) / density
    return [_product_code(dim, directions, density, k) for k in range(CODES)]


def _product_code(dim: int, directions: float, density: float, number: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    blocks = BLOCKS if dim >= NARROW else 1
    each = max(2, math.ceil(directions ** (1 / blocks)))
    draw = np.random.Generator(np.random.PCG64([_SEED, dim, each, number]))
    rotation, _ = np.linalg.qr(draw.standard_normal((dim, dim)))
    codes = []
    for part in np.array_split(np.arange(dim), blocks):
        c = draw.standard_normal((each, len(part)))
        codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(blocks))
    # the threshold is read off random unit vectors: as many directions a vector as the density asks for
    probe = draw.standard_normal((PROBES, dim))
    sums = half_sums(probe / np.linalg.norm(probe, axis=1, keepdims=True), codes)
    low, high, want = 0.0, 1.0, directions * density * PROBES
    for _ in range(30):
        mid = (low + high) / 2
        low, high = (mid, high) if len(list_decode(*sums, mid)[0]) > want else (low, mid)
    return rotation, codes, low


def half_sums(x: np.ndarray, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Products of rotated unit vectors, a row each, with all joined codes of the first and of the second half of the blocks."""
    at, scores = 0, []
    for c in codes:
        scores.append(x[:, at : at + c.shape[1]] @ c.T)
        at += c.shape[1]
    halves = []
    for part in (scores[: (len(scores) + 1) // 2], scores[(len(scores) + 1) // 2 :]):
        total = np.zeros((len(x), 1))
        for s in part:
            total = (total[:, :, None] + s[:, None, :]).reshape(len(x), -1)
        halves.append(total)
    return halves[0], halves[1]


def list_decode(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all directions whose product is at least the threshold.

    A code of the first half counts only if it reaches the threshold with the best of the second, and of those, in order, only as many are looked at as the best of the first
    lets reach it, so that few of all directions are ever summed.
    """
    reach = np.flatnonzero(a.max(1) + b.max(1) >= threshold)
    a, b = a[reach], b[reach]
    if not len(reach):
        return reach, reach
    rows, first = np.nonzero(a >= threshold - b.max(1, keepdims=True))
    most = max(1, int((b >= threshold - a.max(1, keepdims=True)).sum(1).max()))
    order = np.argsort(-b, axis=1, kind="stable")[:, :most]
    best = np.take_along_axis(b, order, 1)
    hit, second = np.nonzero(best[rows] >= (threshold - a[rows, first])[:, None])
    return reach[rows[hit]], first[hit] * b.shape[1] + order[rows[hit], second]


def directions(x: np.ndarray, largest: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all directions, over all product codes, that unit vectors, a row each, exceed."""
    rows, numbers = [], []
    for k, (rotation, codes, threshold) in enumerate(design(x.shape[1], largest, cosine)):
        row, number = list_decode(*half_sums(x @ rotation.T, codes), threshold)
        rows.append(row)
        numbers.append(number * CODES + k)
    return np.concatenate(rows), np.concatenate(numbers)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one dimension, a row each, in double precision, scaled to a largest component of 1."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return x / np.abs(x).max(1, keepdims=True)


def filters(vectors: DataFrame, largest: int, cosine: float) -> DataFrame:
    """(label, dim, direction, key, signs): the directions that each of vectors (key, label, embedding) exceeds, and the signs of its products with 64 planes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes = pc.list_value_length(batch.column("embedding")).to_numpy()
            for dim in np.unique(sizes):
                own = pa.array(np.flatnonzero(sizes == dim))
                x = matrix(batch.column("embedding").take(own))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                row, number = directions(x, largest, cosine)
                planes = np.random.Generator(np.random.PCG64([_SEED, int(dim)])).standard_normal((64, dim))
                signs = ((x @ planes.T > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)
                at = own.take(pa.array(row))
                columns = [batch.column("label").take(at), pa.array(np.full(len(row), dim, np.int32)), pa.array(number, pa.int64()), batch.column("key").take(at), pa.array(signs[row], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "dim", "direction", "key", "signs"])

    kind = dict(vectors.dtypes)["label"]
    return vectors.select("key", "label", "embedding").mapInArrow(decode, f"label {kind}, dim int, direction long, key long, signs long")


_SIDE = ["key", "id", "n", "embedding"]


def _verify(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b, a_id, b_id, a_n, b_n) of those pairs (a, b) of classes (key, id, n, embedding) whose cosine is at least the given one."""
    left, right = (classes.select(*[F.col(c).alias(s if c == "key" else f"{s}_{c}") for c in _SIDE]) for s in ("a", "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = np.zeros(batch.num_rows, bool)
            sizes = pc.list_value_length(batch.column("a_embedding")).to_numpy()
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                x, y = (matrix(batch.column(c).take(pa.array(own))) for c in ("a_embedding", "b_embedding"))
                keep[own] = (x * y).sum(1) >= cosine * np.sqrt((x * x).sum(1) * (y * y).sum(1))
            yield batch.select(["a", "b", "a_id", "b_id", "a_n", "b_n"]).filter(pa.array(keep))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_id", "b_id", "a_n", "b_n", "a_embedding", "b_embedding")
    return both.mapInArrow(check, "a long, b long, a_id long, b_id long, a_n long, b_n long")


def shared_before(left: pa.Array, right: pa.Array, direction: int) -> np.ndarray:
    """Whether each two of a tile share a crowded direction of a lower number. left and right: the crowded directions of each."""
    sides = []
    for lists in (left, right):
        number = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        sides.append((row[number < direction], number[number < direction]))
    common = np.intersect1d(sides[0][1], sides[1][1])
    found = np.zeros((len(left), len(right)), bool)
    for at in range(0, len(common), 2048):
        part, grids = common[at : at + 2048], []
        for (row, number), lists in zip(sides, (left, right), strict=True):
            place = np.searchsorted(part, number)
            inside = (place < len(part)) & (part[np.minimum(place, len(part) - 1)] == number)
            grid = np.zeros((len(lists), len(part)), np.float32)
            grid[row[inside], place[inside]] = 1.0
            grids.append(grid)
        found |= grids[0] @ grids[1].T > 0
    return found


def least_reachable(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each one of the left and right side of a tile reaches over its links."""
    while True:
        down = np.minimum(right, np.where(linked, left[:, None], right).min(0, initial=np.iinfo(np.int64).max))
        across = np.minimum(left, np.where(linked, down, left[:, None]).min(1, initial=np.iinfo(np.int64).max))
        if (down == right).all() and (across == left).all():
            return left, right
        left, right = across, down


def crowded_links(hits: DataFrame, classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(tiles, held): the links of pairs that share a direction of more than CROWD vectors, without a row for each pair.

    The vectors of such a direction are dealt to chunks of about TILE, and each two chunks meet in a tile of their own, a bounded group that
    multiplies them as matrices. A link counts in the first crowded direction that its two vectors share. tiles has, by tile, (key, id, others, low): how many rows a vector is linked
    with and the least id it reaches there. held (key, crowded) lists each vector's crowded directions.
    """
    place = ["label", "dim", "direction"]
    crowds = hits.groupBy(*place).agg(F.count("*").alias("size")).where(F.col("size") > CROWD)
    mine = written(hits.join(crowds, place).select(*place, "key", F.ceil(F.col("size") / TILE).cast("int").alias("chunks")), "caps-crowds")
    held = written(mine.groupBy("key").agg(F.sort_array(F.collect_list("direction")).alias("crowded")), "caps-crowded")
    dealt = mine.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).join(held, "key").join(classes.select(*_SIDE), "key")
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    meets = meets.select(*place, F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"), "chunk", "crowded", *_SIDE)

    def tile(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        p, q, direction = rows["p"][0].as_py(), rows["q"][0].as_py(), rows["direction"][0].as_py()
        left, right = (rows.filter(pc.equal(rows["chunk"], c)).combine_chunks() for c in (p, q))
        if not left.num_rows or not right.num_rows:
            return _no_links()
        x, y = (matrix(t["embedding"].combine_chunks()) for t in (left, right))
        linked = x @ y.T >= cosine * np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1))
        linked &= ~shared_before(left["crowded"].combine_chunks(), right["crowded"].combine_chunks(), direction)
        if p == q:
            np.fill_diagonal(linked, False)
        n = [t["n"].to_numpy() for t in (left, right)]
        low = least_reachable(linked, *(t["id"].to_numpy() for t in (left, right)))
        sides = [(left, linked @ n[1], low[0])] + ([(right, linked.T @ n[0], low[1])] if p < q else [])
        found = [pa.table({"key": t["key"], "id": t["id"], "others": pa.array(others, pa.int64()), "low": pa.array(least, pa.int64())}) for t, others, least in sides]
        found = pa.concat_tables(found)
        return found.filter(pc.greater(found["others"], 0)).combine_chunks()

    return written(meets.groupBy(*place, "p", "q").applyInArrow(tile, "key long, id long, others long, low long"), "caps-tiles"), held


def _no_links() -> pa.Table:
    return pa.table({c: pa.array([], pa.int64()) for c in ("key", "id", "others", "low")})


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Only rows of equal label that is not null are compared. A vector that is null, empty, zero or holds null or non-finite components links with
    nothing, as does a row without vec_id (its component is null and it is kept); vectors of different dimension are not compared. Equal vectors are one class,
    compared once; n_links counts rows. Rows of equal vec_id share a component: what one of their vectors reaches all reach. Other columns are ignored; an empty table gives no rows.
    """
    fine = F.expr("label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(fine, F.lit(False)).alias("fine"))
    keys = [F.xxhash64(F.lit(k), "embedding").alias(f"h{k}") for k in (1, 2)]
    good = rows.where("fine").select("vec_id", "label", "embedding", *keys)
    classes = good.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "caps-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    hits = written(filters(classes, largest, cosine), "caps-filters")
    tiles, held = crowded_links(hits, classes, cosine)

    # pairs that share no crowded direction, of which at most CROWD vectors meet at once
    place = ["label", "dim", "direction"]
    few = hits.join(hits.groupBy(*place).agg(F.count("*").alias("size")).where(F.col("size").between(2, CROWD)).select(*place), place)
    a, b = (few.select(*place, F.col("key").alias(s), F.col("signs").alias(f"signs_{s}")) for s in ("a", "b"))
    # at the least cosine 23 or fewer of 64 signs differ but for one pair in ten million
    off = math.acos(min(1.0, cosine)) / math.pi
    limit = math.ceil(64 * off + 6 * math.sqrt(64 * off * (1 - off)))
    met = a.join(b, place).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("signs_a").bitwiseXOR(F.col("signs_b"))) <= limit)).select("a", "b").distinct()
    for side in ("a", "b"):
        met = met.join(held.select(F.col("key").alias(side), F.col("crowded").alias(f"crowded_{side}")), side, "left")
    met = met.where(~F.coalesce(F.arrays_overlap("crowded_a", "crowded_b"), F.lit(False))).select("a", "b")
    links = written(_verify(met, classes, cosine), "caps-links")

    counts = [links.select(F.col("a").alias("key"), F.col("b_n").alias("others")), links.select(F.col("b").alias("key"), F.col("a_n").alias("others")), tiles.select("key", "others")]
    near = counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("key").agg(F.sum("others").alias("others"))
    edges = links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(tiles.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())
    several = good.groupBy("vec_id").agg(F.min(F.struct("label", *keys)).alias("least"), F.max(F.struct("label", *keys)).alias("most")).where("least <> most").select("vec_id")
    same = good.select("vec_id", "label", *keys).join(several, "vec_id", "left_semi").join(classes.select("label", "h1", "h2", "id"), ["label", "h1", "h2"])
    edges = edges.unionByName(same.where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b")))
    components = connected_components(edges).withColumnRenamed("node", "id")
    found = classes.select("label", "h1", "h2", "key", "id", "n").join(near, "key", "left").join(components, "id", "left")
    found = written(found.select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "caps-found")
    linked = rows.select("vec_id", "label", "fine", *keys).join(found, ["label", "h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce(F.when(F.col("fine"), F.col("component_id")), F.col("vec_id")))
    return linked.select("vec_id", F.coalesce(F.when(F.col("fine"), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
