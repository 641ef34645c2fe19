"""Tables in hash buckets, of which a merge rewrites only those it touches.

A table is a folder with data/<number>/_bucket=<k>, what merge <number> has written, and manifest/<number>: for every bucket the folder that holds it. A manifest is complete once
its _SUCCESS is there and is written last, so readers see a merge as a whole or not at all; what a broken-off merge has left is written anew under its number. Older versions stay until vacuum().
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.sources.scratch import _at, delete


def _names(spark: SparkSession, path: str) -> list[str]:
    store, where = _at(spark, path)
    return [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished merges, in order."""
    found = [int(n) for n in _names(spark, f"{path}/manifest") if n.isdigit()]
    return sorted(n for n in found if "_SUCCESS" in _names(spark, f"{path}/manifest/{n:012d}"))


def _manifest(spark: SparkSession, path: str, number: int) -> tuple[dict[int, str], StructType, int]:
    """(folder of each bucket, schema, number of buckets); one row a bucket."""
    rows = spark.read.parquet(f"{path}/manifest/{number:012d}").collect()
    return {r["bucket"]: r["folder"] for r in rows if r["folder"]}, StructType.fromJson(json.loads(rows[0]["shape"])), rows[0]["buckets"]


def read(spark: SparkSession, path: str, before: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The table as the newest finished merge (before a number) has left it, or only some of its buckets; None if there is none."""
    done = [n for n in versions(spark, path) if before is None or n < before]
    if not done:
        return None
    folders, schema, _ = _manifest(spark, path, done[-1])
    own = [f for k, f in sorted(folders.items()) if buckets is None or k in buckets]
    return spark.read.schema(schema).parquet(*own) if own else spark.createDataFrame([], schema)


def number_of_buckets(spark: SparkSession, path: str) -> int | None:
    """How many buckets a table has, None if there is none."""
    done = versions(spark, path)
    return _manifest(spark, path, done[-1])[2] if done else None


def bucket_of(key: str | None, buckets: int) -> Column:
    """The bucket of a row by a column; without one there is a single bucket."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(buckets)).cast("int") if key else F.lit(0)


def merge(batch: DataFrame, path: str, key: str | None, combine: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = 64, number: int | None = None, touched: set[int] | None = None, place: Column | None = None) -> int:
    """Write combine(rows of the touched buckets or None, batch) as the new content of the buckets that batch has keys of; gives the merge's number.

    The rows of a key must come from rows of that key. With a number of the caller's a merge can be run again: it starts from the merges before it. The number of buckets is that of the first merge.
    With touched the caller names the buckets to rewrite, also such as batch has no rows of; with place a column that gives a row's bucket, instead of the key's hash.
    """
    spark = batch.sparkSession
    done = [n for n in versions(spark, path) if number is None or n < number]
    number = (done[-1] + 1 if done else 0) if number is None else number
    folders, _, buckets = _manifest(spark, path, done[-1]) if done else ({}, None, buckets)
    touched = touched if touched is not None else {r[0] for r in batch.select((bucket_of(key, buckets) if place is None else place.cast("int")).alias("b")).distinct().collect()}  # at most all buckets
    current = read(spark, path, number, touched) if done else None
    merged = combine(current, batch)
    held = merged.withColumn("_bucket", bucket_of(key, buckets) if place is None else place.cast("int"))
    data = f"{path}/data/{number:012d}"
    held.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(data)
    own = {int(n.rpartition("=")[2]): f"{data}/{n}" for n in _names(spark, data) if n.startswith("_bucket=")}
    folders = {k: f for k, f in folders.items() if k not in touched} | own
    rows = [(k, folders.get(k), merged.schema.json() if k == 0 else None, buckets) for k in range(buckets)]
    spark.createDataFrame(rows, "bucket int, folder string, shape string, buckets int").orderBy("bucket").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{number:012d}")
    return number


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the manifests but for the newest few, and the data that no kept manifest names."""
    done = versions(spark, path)
    kept = done[-keep:]
    used = {f.rpartition("/_bucket=")[0] for n in kept for f in _manifest(spark, path, n)[0].values()}
    buckets = {f for n in kept for f in _manifest(spark, path, n)[0].values()}
    for n in done[:-keep]:
        delete(spark, f"{path}/manifest/{n:012d}")
    for name in _names(spark, f"{path}/data"):
        folder = f"{path}/data/{name}"
        if int(name) > done[-1]:
            continue  # a merge under way
        if folder not in used:
            delete(spark, folder)
            continue
        for bucket in _names(spark, folder):
            if bucket.startswith("_bucket=") and f"{folder}/{bucket}" not in buckets:
                delete(spark, f"{folder}/{bucket}")
