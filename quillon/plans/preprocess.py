"""The preprocessing of a catalogue and its fingerprint; ingest; the recommendation page."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import clean, features, filters, matching, rank, scoring
from quillon.schema import CATALOGUE
from quillon.sources import buckets, files
from quillon.sources.scratch import stored


def fingerprint(df: DataFrame, parts: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """One row: digest of dictionary stamps, row count and greatest id; with content also of all cells (K1)."""
    seen = [F.lit(p) for p in parts] + [F.count("*").cast("string"), F.coalesce(F.max("id"), F.lit(""))]
    if content:
        seen.append(F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string"))
    return df.agg(F.md5(F.concat_ws("|", *seen)).alias("fingerprint"))


@dataclass
class Dictionaries:
    """Stop lists and synonym maps; small, as literals."""

    stop_tags: set[str]
    tag_map: dict[str, str]
    stop_words: set[str]
    word_map: dict[str, str]

    def stamp(self) -> str:
        """A digest of all entries."""
        held = (sorted(self.stop_tags), sorted(self.tag_map.items()), sorted(self.stop_words), sorted(self.word_map.items()))
        return hashlib.md5(repr(held).encode()).hexdigest()


@dataclass
class Prepared:
    """A catalogue with features, and how often they occur."""

    items: DataFrame
    freqs: scoring.Frequencies
    stamp: str = ""  # the fingerprint of what it was made from, if it is stored


def features_of(catalogue: DataFrame, dictionaries: Dictionaries, folders: DataFrame | None = None, title_fallback: bool = False) -> DataFrame:
    """Folders, parsed tags, title words and search text of each item; every row by itself but for the folder match."""
    df = clean.title_fallback(catalogue) if title_fallback else catalogue
    df = matching.match_close(df, folders) if folders is not None else df.withColumn("local_path", F.lit(matching.NO_FOLDER))
    df = features.parse_tags(df, dictionaries.stop_tags, dictionaries.tag_map)
    df = features.title_words(features.tokenize_titles(df), dictionaries.stop_words, dictionaries.word_map).drop("tokens")
    return clean.with_search_text(df)


def preprocess(catalogue: DataFrame, dictionaries: Dictionaries, folders: DataFrame | None = None, title_fallback: bool = False, keep: bool = True) -> Prepared:
    """Folders, parsed tags, title words and search text of each item, and frequencies (K2).

    With keep the features are written once, since frequencies, scores and pages all read them; the table goes with the application.
    """
    df = features_of(catalogue, dictionaries, folders, title_fallback)
    if keep:
        df = stored(df, "features")
    return Prepared(df, scoring.all_frequencies(df))


def _digest(df: DataFrame) -> str:
    return df.agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")))).first()[0]


def fingerprints(catalogue: DataFrame, parts: tuple[str, ...], number: int) -> dict[int, str]:
    """A digest of stamps and all cells for each hash bucket of id that has rows (K1 by parts)."""
    held = catalogue.groupBy(buckets.bucket_of("id", number).alias("bucket"))
    content = F.concat_ws("|", *[F.lit(p) for p in parts], F.count("*").cast("string"), F.sum(F.xxhash64(*catalogue.columns).cast("decimal(38,0)")).cast("string"))
    return {r[0]: r[1] for r in held.agg(F.md5(content)).collect()}  # one row a bucket


def preprocess_parts(catalogue: DataFrame, dictionaries: Dictionaries, folder: str, folders: DataFrame | None = None, title_fallback: bool = False, number: int = 64) -> Prepared:
    """preprocess(), kept at a folder in hash buckets of id: only buckets whose rows have changed since the last call are worked out anew (K1, K2).

    Frequencies are kept up likewise: what the changed buckets counted before is taken away from the totals, what they count now is added. Items, counts by bucket and totals are written under
    one number and the fingerprints last, so a run that broke off is made good by the next one, which starts from the last finished number. The number of buckets is that of the first call.
    """
    spark = catalogue.sparkSession
    base = folder.rstrip("/")
    stamps = (dictionaries.stamp(), str(title_fallback), _digest(folders) if folders is not None else "")
    items, counts, totals, prints = (f"{base}/{name}" for name in ("items", "counts", "totals", "fingerprints"))
    done = buckets.versions(spark, prints)
    last, turn = (done[-1] if done else None), (done[-1] + 1 if done else 0)
    number = buckets.number_of_buckets(spark, items) or number if done else number
    known = {} if last is None else {r["bucket"]: r["print"] for r in buckets.read(spark, prints).collect()}
    now = fingerprints(catalogue, stamps, number)
    changed = {k for k in now.keys() | known.keys() if now.get(k) != known.get(k)}
    if changed or last is None:
        own = catalogue.where(buckets.bucket_of("id", number).isin(sorted(changed)))
        buckets.merge(features_of(own, dictionaries, folders, title_fallback), items, "id", lambda before, new: new, number, turn, changed)
        fresh = buckets.read(spark, items, buckets=changed).withColumn("bucket", buckets.bucket_of("id", number))
        fresh = scoring.frequencies_by(fresh, "bucket")
        buckets.merge(fresh, counts, "bucket", lambda before, new: new, number, turn, changed, F.col("bucket"))
        delta = buckets.read(spark, counts, turn + 1, changed)
        every = delta.select("facet", "feature", "freq")
        if last is not None:
            old = buckets.read(spark, counts, turn, changed)
            every = every.unionByName(old.select("facet", "feature", (-F.col("freq")).alias("freq"))).unionByName(buckets.read(spark, totals, turn))
        total = every.groupBy("facet", "feature").agg(F.sum("freq").alias("freq")).where("freq > 0")
        buckets.merge(total, totals, None, lambda before, new: new, 1, turn, {0})
        table = spark.createDataFrame(sorted(now.items()), "bucket int, print string")
        buckets.merge(table, prints, None, lambda before, new: new, 1, turn, {0})
    table = buckets.read(spark, totals)
    freqs = scoring.Frequencies(*[table.where(F.col("facet") == f).select("feature", "freq") for f in scoring.FACETS], table)
    return Prepared(buckets.read(spark, items), freqs, hashlib.md5(repr((stamps, sorted(now.items()))).encode()).hexdigest())


def preprocess_stored(catalogue: DataFrame, dictionaries: Dictionaries, folder: str, folders: DataFrame | None = None, title_fallback: bool = False, content: bool = True) -> Prepared:
    """preprocess(), stored as Parquet under the fingerprint of its inputs and read again while they stay the same (K2).

    Without content the fingerprint has row count and greatest id only (K1), which misses changed cells. What a broken-off run has left is written anew: the
    table done comes last. Old fingerprints stay in the folder until their owner deletes them.
    """
    spark = catalogue.sparkSession
    parts = [dictionaries.stamp(), str(title_fallback)]
    if folders is not None:
        parts.append(_digest(folders))
    path = f"{folder.rstrip('/')}/{fingerprint(catalogue, tuple(parts), content).first()['fingerprint']}"

    def kept() -> Prepared:
        table = spark.read.parquet(f"{path}/frequencies")
        freqs = scoring.Frequencies(*[table.where(F.col("facet") == f).select("feature", "freq") for f in scoring.FACETS], table)
        return Prepared(spark.read.parquet(f"{path}/items"), freqs, path.rpartition("/")[2])

    try:
        spark.read.parquet(f"{path}/done")
    except AnalysisException:
        preprocess(catalogue, dictionaries, folders, title_fallback, keep=False).items.write.mode("overwrite").parquet(f"{path}/items")
        scoring.all_frequencies(spark.read.parquet(f"{path}/items")).together().write.mode("overwrite").parquet(f"{path}/frequencies")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return kept()


def ingest(raw: DataFrame, current: DataFrame | None, bookmarks: DataFrame | None = None) -> DataFrame:
    """Raw rows cleaned, one an id, and merged into the current table."""
    df = clean.attach_file_names(raw, bookmarks) if bookmarks is not None else raw
    batch = clean.normalise_catalogue(df, ["_file", "_pos"])
    if current is None:
        return batch
    return files.upsert_catalogue(clean.backfill_id_from_link(current).select(*CATALOGUE), batch)


@dataclass
class View:
    """A scored catalogue in order of score, stored once, and the threshold below which rows are not shown."""

    order: rank.StoredOrder
    threshold: int

    def page(self, query: str = "", page_index: int = 0, size: int = 500) -> DataFrame:
        """A page of what is shown (W2). Rows under the threshold stand at the order's end, so a page is read by its place; only a keyword query has to look at all rows."""
        if not filters.query_terms(query):
            return filters.min_score(self.order.page(page_index, size), self.threshold)
        shown = filters.keyword_search(filters.min_score(self.order.rows, self.threshold), query)
        return rank.page(shown, rank.sort_order(), page_index, size).drop("_part", "_nth")


def view(prepared: Prepared, history: DataFrame | None = None, weights: scoring.Weights | None = None, blocked: list[str] | None = None, path: str | None = None) -> View:
    """Score the catalogue and keep it in order: at a path, or until the application ends. Blocked items go before they are scored."""
    scored = scoring.recommend(filters.block_tags(prepared.items, blocked or []), prepared.freqs, weights, history=history)
    order = rank.store_order(scored, rank.sort_order(), path)
    return View(order, filters.score_bounds(order.rows).first()["threshold"])


def view_stored(prepared: Prepared, folder: str, blocked: list[str] | None = None) -> View:
    """view() of stored features, kept beside them and opened again for further pages while the features and the block list are the same."""
    spark = prepared.items.sparkSession
    path = f"{folder.rstrip('/')}/view-{hashlib.md5(repr((prepared.stamp, sorted(blocked or []))).encode()).hexdigest()}"
    try:
        order = rank.open_order(spark, path)
    except AnalysisException:
        return view(prepared, blocked=blocked, path=path)
    return View(order, filters.score_bounds(order.rows).first()["threshold"])


def recommend_page(prepared: Prepared, history: DataFrame | None = None, weights: scoring.Weights | None = None, blocked: list[str] | None = None, query: str = "", page_index: int = 0, size: int = 500) -> DataFrame:
    """A single page of the filtered, scored catalogue (W2); for several, keep the view()."""
    return view(prepared, history, weights, blocked).page(query, page_index, size)
