"""Vector work: exact top-k by product or cosine, item means, and an index that is refreshed by what changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.sources import files
from quillon.sources.scratch import stored

#: Fixed value: the text that stands for an item in text search.
DOCUMENT = "标题《%s》，作者 %s，团队 %s，语言 %s，元素标签：%s。"


def semantic_documents(df: DataFrame, most: int = 800) -> DataFrame:
    """(id, document) of rows with an id (F1)."""
    text = F.format_string(DOCUMENT, *[T.filled(F.col(c)) for c in ("title", "author", "team", "language", "tags")])
    return df.where("id <> ''").select("id", F.substring(text, 1, most).alias("document"))


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder for tests: counts of hashed words."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.split():
                out[i, xxhash.xxh32_intdigest(w.encode()) % dim] += 1.0
        return out

    return encode


def embed(df: DataFrame, col: str, encoder: Callable[[list], np.ndarray], out: str = "embedding", batch: int = 16) -> DataFrame:
    """df with unit vectors of a column, encoded in batches by a caller's encoder (F2)."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = []
            for at in range(0, len(part), batch):
                x = np.asarray(encoder(part.iloc[at : at + batch].tolist()), np.float64)
                rows += list((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32))
            yield pd.Series(rows, dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "array<float>")(col))


def product(embedding: str, query: list[float], cosine: bool = False) -> Column:
    """Product of vectors with a query in Arrow batches; a vector of another dimension gives null."""
    q = np.asarray(query, np.float64)
    if cosine:
        q = q / max(float(np.linalg.norm(q)), 1e-12)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            fits = part.map(lambda v: v is not None and len(v) == len(q)).to_numpy(bool)
            out = pd.Series(np.nan, index=part.index, dtype="float64")
            if fits.any():
                x = np.stack(part[fits].to_list()).astype(np.float64)
                out[fits] = x @ q / (np.maximum(np.linalg.norm(x, axis=1), 1e-12) if cosine else 1.0)
            yield out.astype(object).where(out.notna(), None)

    return F.pandas_udf(run, "double")(embedding)


def semantic_topk(items: DataFrame, vectors: DataFrame, query: list[float], k: int = 5000) -> DataFrame:
    """(id, semantic_score) of the k items nearest to the query by cosine, times 100; only items that have a vector."""
    scored = vectors.join(items.select("id"), "id", "left_semi").select("id", (product("embedding", query, cosine=True) * 100).alias("semantic_score"))
    return scored.where("semantic_score IS NOT NULL").orderBy(F.col("semantic_score").desc(), "id").limit(k)


#: Vectors, and queries, that are multiplied at a time when the queries are a table.
CHUNK, BLOCK = 2048, 256
#: Steps of the ranks whose scores a chunk tells in the first pass, and bins of scores on either side of 0.
STEP, BINS = 1.5, 5_000


def _packed(df: DataFrame, key: str, rows: int, extra: str | None = None) -> DataFrame:
    """(dim, keys, data, extras, centre, spread, longest): up to so many rows (key, embedding) of one dimension packed into one.

    Vectors that are null, empty, or hold nulls or non-finite numbers are left out. Rows of a batch are cut into packs by the side of a few planes that they lie on, so that a pack's vectors point in like
    directions: centre is their mean direction, spread the largest angle to it, longest the largest norm.
    """
    held = df.where("size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL)").select(F.col(key).cast("string").alias("key"), "embedding", (F.col(extra) if extra else F.lit(None)).cast("long").alias("extra"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("embedding").value_lengths().to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = part.column("embedding").flatten().to_numpy().astype(np.float64).reshape(-1, dim)
                planes = np.random.default_rng(int(dim)).normal(size=(int(dim), 6))
                order = np.lexsort((x @ planes > 0).T)
                order = order[np.isfinite(x[order]).all(1)]
                for at in range(0, len(order), rows):
                    own = order[at : at + rows]
                    unit, norms = _unit(x[own])
                    centre, _ = _unit(unit.mean(0, keepdims=True))
                    spread = float(np.arccos(np.clip(unit @ centre[0], -1, 1)).max())
                    columns = [pa.array([int(dim)], pa.int32()), *[pa.array([part.column(c).take(pa.array(own)).to_pylist()], pa.list_(t)) for c, t in (("key", pa.string()), ("extra", pa.int64()))]]
                    more = [pa.array([x[own].tobytes()]), pa.array([centre.tobytes()]), pa.array([spread]), pa.array([float(norms.max())])]
                    yield pa.RecordBatch.from_arrays([*columns, *more], names=["dim", "keys", "extras", "data", "centre", "spread", "longest"])

    return held.mapInArrow(pack, "dim int, keys array<string>, extras array<long>, data binary, centre binary, spread double, longest double")


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(x, axis=1)
    return x / np.maximum(norms, 1e-12)[:, None], norms


def _products(row: dict, cosine: bool, scale: float, some: np.ndarray | None = None) -> np.ndarray:
    """Scores of a block's queries (or some of them) with a chunk's vectors, rounded to six decimals."""
    pool, asked = (np.frombuffer(row[c], np.float64).reshape(-1, row["dim"]) for c in ("data", "wanted"))
    asked = asked if some is None else asked[some]
    if cosine:
        pool, asked = _unit(pool)[0], _unit(asked)[0]
    return np.round(asked @ pool.T * scale, 6)


def _bin_of(scores: np.ndarray, row: dict, cosine: bool, scale: float, most: float, some: np.ndarray | None = None) -> np.ndarray:
    """The bins of scores (query by vector): BINS to the largest product that the query can have with any vector."""
    asked = np.frombuffer(row["wanted"], np.float64).reshape(-1, row["dim"])
    norms = np.ones(len(asked)) if cosine else np.maximum(np.linalg.norm(asked, axis=1) * most, 1e-12)
    return np.floor(scores / scale / (norms if some is None else norms[some])[:, None] * BINS).astype(np.int64)


def nearest(pool: DataFrame, queries: DataFrame, k: int, cosine: bool = True, scale: float = 1.0) -> DataFrame:
    """(query_id, rank, id, score): for each of queries (query_id, embedding) the k rows of pool (id, embedding) of greatest product or cosine, times scale, ties by id.

    Exact, in two passes over chunks of vectors against blocks of queries. In the first, a chunk tells of each query only its scores at a few ranks (1, 2, 3, 4, 6, 9, ..), each standing for the vectors between
    ranks; summed up by bins of scores they give a bound that at least k vectors reach. The second pass skips the queries that nothing in a chunk can reach, by the chunk's centre
    and spread, and gives only scores in or above the bound's bin: little over k rows a query, whatever k is. Chunks go to one partition each, the far smaller blocks to all.
    """
    spread = pool.sparkSession.sparkContext.defaultParallelism
    chunks = stored(_packed(pool, "id", CHUNK).drop("extras").withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(spread))), "chunks")
    most = chunks.agg(F.max("longest")).first()[0] or 0.0

    def met(asked: DataFrame) -> DataFrame:
        blocks = _packed(asked, "query_id", BLOCK, "floor").select("dim", F.col("keys").alias("asked"), F.col("extras").alias("floors"), F.col("data").alias("wanted"))
        blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumn("salt", F.col("salt").cast("long"))
        return chunks.join(blocks, ["dim", "salt"]).drop("salt")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield {c: batch.column(c)[at].as_py() for c in batch.schema.names}

    def ranks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            scores = _products(row, cosine, scale)
            n = min(k, scores.shape[1])
            ranks = np.unique(np.append(np.floor(STEP ** np.arange(64)).clip(1, n), n)).astype(np.int64)
            places = scores.shape[1] - ranks
            told = np.partition(scores, np.unique(places), axis=1)[:, places]
            number = _bin_of(told, row, cosine, scale, most)
            asked = pa.array(row["asked"], pa.string()).take(pa.array(np.repeat(np.arange(len(told)), len(ranks))))
            yield pa.RecordBatch.from_arrays([asked, pa.array(number.ravel()), pa.array(np.tile(np.diff(ranks, prepend=0), len(told)))], names=["query_id", "bin", "n"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            floors = np.array([np.iinfo(np.int64).min if f is None else f for f in row["floors"]])
            asked = np.frombuffer(row["wanted"], np.float64).reshape(-1, row["dim"])
            unit, norms = _unit(asked)
            angle = np.arccos(np.clip(unit @ np.frombuffer(row["centre"], np.float64), -1, 1)) - row["spread"] - 1e-6
            reach = np.cos(np.clip(angle, 0, np.pi))
            if not cosine:  # the longest vector in the nearest direction; none has more than 0 beyond a right angle
                reach = np.maximum(reach, 0) * row["longest"] / max(most, 1e-12)
            some = np.flatnonzero(np.ceil(reach * BINS) + 1 >= floors)
            if not len(some):
                continue
            scores = _products(row, cosine, scale, some)
            q, v = np.nonzero(_bin_of(scores, row, cosine, scale, most, some) >= floors[some][:, None])
            yield pa.RecordBatch.from_arrays([pa.array(row["asked"], pa.string()).take(pa.array(some[q])), pa.array(row["keys"], pa.string()).take(pa.array(v)), pa.array(scores[q, v])], names=["query_id", "id", "score"])

    k = max(1, k)
    plain = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    told = met(plain.withColumn("floor", F.lit(None))).mapInArrow(ranks_of, "query_id string, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
    reached = told.withColumn("total", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("bin").desc()))).where(F.col("total") >= k)
    floors = stored(reached.groupBy("query_id").agg(F.max("bin").alias("floor")), "floors")
    found = met(plain.join(floors, "query_id", "left")).mapInArrow(best, "query_id string, id string, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def semantic_topk_queries(items: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5000) -> DataFrame:
    """(query_id, rank, id, semantic_score): the k items nearest to each of queries (query_id, embedding) by cosine, times 100 (F4 for a table of queries).

    Scores are rounded to six decimals before they are ranked, so that equal vectors tie; ties go by id. Vectors that are null, empty, hold nulls or
    non-finite numbers, or have another dimension than a query are not among its results.
    """
    found = nearest(vectors.join(items.select("id"), "id", "left_semi"), queries, k, True, 100.0)
    return found.withColumnRenamed("score", "semantic_score")


def item_vectors(images: DataFrame) -> DataFrame:
    """(item_id, embedding): unit mean of each item's unit image vectors.

    Images without item, or whose vector is null, empty or holds nulls, are left out; where dimensions differ, a place's mean is over the vectors that have it. Each Arrow
    batch gives one sum of arrays an item, so that neither components nor the images of a large item are shuffled one by one; sums of an item come sorted into
    one task and are added as they pass.
    """
    unit = images.select(T.strip(T.filled(F.col("item_id"))).alias("item_id"), F.col("embedding")).where("item_id <> '' AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL)")
    unit = unit.select("item_id", T.l2_normalise(F.col("embedding")).alias("v"))
    schema = pa.schema([("item_id", pa.string()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("v").value_lengths().to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                ids = part.column("item_id").dictionary_encode()
                codes = ids.indices.to_numpy()
                x = part.column("v").flatten().to_numpy().reshape(-1, dim)
                order = np.argsort(codes, kind="stable")
                found, starts, n = np.unique(codes[order], return_index=True, return_counts=True)
                totals = np.add.reduceat(x[order], starts, axis=0)
                yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(found)), pa.array(n, pa.int64()), pa.array(list(totals), pa.list_(pa.float64()))], schema=schema)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, total, count = None, np.zeros(0), np.zeros(0)
        for batch in batches:
            done: list[tuple[str, np.ndarray]] = []
            for own, n, more in zip(batch.column("item_id").to_pylist(), batch.column("n").to_pylist(), batch.column("total"), strict=True):
                if own != item:
                    if item is not None:
                        done.append((item, total / count))
                    item, total, count = own, np.zeros(0), np.zeros(0)
                x = more.values.to_numpy()
                if len(x) > len(total):
                    total, count = (np.pad(a, (0, len(x) - len(a))) for a in (total, count))
                total[: len(x)] += x
                count[: len(x)] += n
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], pa.string()), pa.array([m for _, m in done], pa.list_(pa.float64()))], names=["item_id", "v"])
        if item is not None:
            yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([total / count], pa.list_(pa.float64()))], names=["item_id", "v"])

    partial = unit.mapInArrow(sums, "item_id string, n long, total array<double>")
    joined = partial.repartition("item_id").sortWithinPartitions("item_id").mapInArrow(means, "item_id string, v array<double>")
    return joined.select("item_id", T.l2_normalise(F.col("v")).alias("embedding"))


def cover_topk(item_vecs: DataFrame, query_id: str | None = None, query_vector: list[float] | None = None, candidates: DataFrame | None = None, k: int = 5000) -> DataFrame:
    """(rank, id, cover_score): items nearest to an item or a given vector, product times 100.

    A given vector beats an id; an id is stripped and upper-cased and must be indexed; so are candidates (id), None meaning all.
    """
    if query_vector is None:
        own = (query_id or "").strip().upper()
        row = item_vecs.where(F.col("item_id") == own).first()
        if row is None:
            raise ValueError(f"not indexed: {own}")
        query_vector = list(row["embedding"])
    pool = item_vecs
    if candidates is not None:
        pool = pool.join(candidates.select(F.upper(T.strip(F.col("id"))).alias("item_id")).distinct(), "item_id", "left_semi")
    scored = pool.select(F.col("item_id").alias("id"), (product("embedding", query_vector) * 100).alias("cover_score"))
    best = scored.orderBy(F.col("cover_score").desc(), "id").limit(max(1, k))
    return ranked(best, [F.col("cover_score").desc(), F.col("id")]).select("rank", "id", "cover_score")


def cover_topk_queries(item_vecs: DataFrame, query_ids: DataFrame, candidates: DataFrame | None = None, k: int = 5000) -> DataFrame:
    """(query_id, rank, id, cover_score): cover_topk for every id of a table (query_id), stripped and upper-cased; one that is not indexed has no rows (F6 for a table of queries)."""
    asked = query_ids.select(F.upper(T.strip(F.col("query_id"))).alias("item_id")).distinct().join(item_vecs, "item_id").select(F.col("item_id").alias("query_id"), "embedding")
    pool = item_vecs
    if candidates is not None:
        pool = pool.join(candidates.select(F.upper(T.strip(F.col("id"))).alias("item_id")).distinct(), "item_id", "left_semi")
    return nearest(pool.select(F.col("item_id").alias("id"), "embedding"), asked, k, False, 100.0).withColumnRenamed("score", "cover_score")


def ranked(best: DataFrame, order: list[Column]) -> DataFrame:
    """rank from 1 over the few rows of a top list."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def image_topk(index: DataFrame, query_vector: list[float], k: int = 10, source: str = "all") -> DataFrame:
    """(rank, path, source, name, item_id, score) of the k nearest images by product."""
    pool = index if source == "all" else index.where(F.col("source") == source)
    best = pool.select("path", "source", "name", "item_id", product("embedding", query_vector).alias("score")).orderBy(F.col("score").desc(), "path").limit(max(1, k))
    return ranked(best, [F.col("score").desc(), F.col("path")]).select("rank", "path", "source", "name", "item_id", "score")


def image_topk_queries(index: DataFrame, queries: DataFrame, k: int = 10, source: str = "all") -> DataFrame:
    """(query_id, rank, path, source, name, item_id, score): image_topk for every vector of a table (query_id, embedding) (F7 for a table of queries)."""
    pool = index if source == "all" else index.where(F.col("source") == source)
    found = nearest(pool.select(F.col("path").alias("id"), "embedding"), queries, k, False).withColumnRenamed("id", "path")
    return found.join(pool.select("path", "source", "name", "item_id"), "path").select("query_id", "rank", "path", "source", "name", "item_id", "score")


def index_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): unchanged, add_or_update or deleted, by size, mtime and source; embeddings stay out of the join (F8)."""
    a = old.select("path", *[F.col(c).alias(f"old_{c}") for c in ("source", "size", "mtime_ns")])
    b = new.select("path", "source", "size", "mtime_ns", F.lit(True).alias("here"))
    both = a.join(b, "path", "full")
    same = F.col("old_mtime_ns").eqNullSafe(F.col("mtime_ns")) & F.col("old_size").eqNullSafe(F.col("size")) & F.col("old_source").eqNullSafe(F.col("source"))
    return both.select("path", F.when(F.col("here").isNull(), "deleted").when(same, "unchanged").otherwise("add_or_update").alias("status"))


def is_consistent(index: DataFrame) -> bool:
    """Whether every row of an index has a path of its own and a vector, all of one dimension, without nulls in it."""
    size = F.when(F.forall("embedding", lambda x: x.isNotNull()), F.size("embedding"))
    by_path = index.groupBy("path").agg(F.count("*").alias("n"), F.count(size).alias("sound"), F.min(size).alias("low"), F.max(size).alias("high"))
    bad = (F.col("n") > 1) | (F.col("sound") < F.col("n")) | F.col("path").isNull()
    seen = by_path.agg(F.count(F.when(bad, 1)).alias("bad"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    return seen["bad"] == 0 and seen["low"] == seen["high"] and seen["low"] != 0


def refresh_index(old: DataFrame | None, manifest: DataFrame, encoder: Callable[[list], np.ndarray], model: str, old_model: str | None = None, rebuild: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """The index of a manifest (path, source, name, item_id, size, mtime_ns, content): vectors of unchanged images are kept, others encoded.

    Everything is encoded on request, without an index, after a change of model, or when the index is inconsistent (is_consistent). Images without content
    are skipped; none at all is an error. With order, columns of the manifest, rows come in that order;
    they are written once before the sort, whose sampling would encode all images a second time.
    """
    if manifest.isEmpty():
        raise ValueError("no images")
    columns = ["path", "source", "name", "item_id", "size", "mtime_ns"]
    extra = [c for c in order if c not in columns]
    if rebuild or old is None or old_model != model or not is_consistent(old):
        todo, kept = manifest, None
    else:
        status = index_diff(old, manifest)
        same = status.where("status = 'unchanged'").select("path")
        kept = manifest.select(*columns, *extra).join(same, "path", "left_semi").join(old.select("path", "embedding"), "path").select(*columns, *extra, "embedding")
        todo = manifest.join(status.where("status = 'add_or_update'").select("path"), "path", "left_semi")
    fresh = embed(todo.where("content IS NOT NULL"), "content", encoder, batch=64).select(*columns, *extra, "embedding")
    index = fresh if kept is None else kept.unionByName(fresh)
    if order:
        path = files.scratch(index.sparkSession, "index")
        index.write.parquet(path)
        index = index.sparkSession.read.schema(index.schema).parquet(path).orderBy(*order)
    return index.select(*columns, "embedding")


def index_stats(index: DataFrame) -> DataFrame:
    """(source, images, dimension), and a row 'all' (F10)."""
    by = index.groupBy("source").agg(F.count("*").alias("images"), F.max(F.size("embedding")).alias("dimension"))
    return by.unionByName(index.agg(F.lit("all").alias("source"), F.count("*").alias("images"), F.max(F.size("embedding")).alias("dimension")))


def attach_similarity(df: DataFrame, matches: DataFrame, score_col: str) -> DataFrame:
    """Rows of matched ids with their score, best first; rows that repeat an id all stay."""
    return df.join(matches.select("id", score_col), "id").orderBy(F.col(score_col).desc(), "id")
