"""Helpers that the operators share: reading tables, words, written tables, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of whole texts that a Python helper takes out of an Arrow batch at a time, at most.
BATCH = 500
_OWNED: set[str] = set()
#: Session settings that hold while a table is written.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: Bytes up to which a table is broadcast by Spark's guess of its size. The guess goes by compressed files and by columns of default widths, and takes no account of an explode: a table
#: guessed at Spark's 10 MB can have hundreds of MB, all of which go through the driver.
GUESSED = 256 << 10
_STATIC, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, in the shared one; the driver deletes it when it ends."""
    found = f"{shared_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if found not in _OWNED:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(where)
        store.deleteOnExit(where)
        _OWNED.add(found)
    return found


def _broadcasts(spark: SparkSession) -> dict[str, str]:
    """Settings by which a table is broadcast up to the session's threshold where its size was measured, and up to GUESSED, if that is less, where it is guessed."""
    most = spark.conf.get(_STATIC)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most) if not most.startswith("-") else -1
    return {_STATIC: str(min(size, GUESSED)), _MEASURED: spark.conf.get(_MEASURED, None) or most}


def written(df: DataFrame, name: str) -> DataFrame:
    """A Parquet table in the shared folder, reread: columnar, compressed, with a size the planner knows; a lost executor loses nothing of it. clean_up() deletes it.

    While it is written, Arrow batches are small, since rows may hold whole texts, Spark is asked to drop the write's shuffle files at its end, since nothing else reads them, and
    only tables of measured size, or guessed to be very small, are broadcast.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid4().hex}"
    held = _WRITING | _broadcasts(spark)
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(table: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        _delete(table.sparkSession, folder)


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; call it when the results that were made from them are written."""
    _delete(spark, scratch_dir(spark))


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The batches of a Python helper in parts of so many rows, so that whole texts are taken out of Arrow a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # the worker lives on


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lowered; the white space of bytes.split is that of WORD."""
    return text.lower().split()


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text has this remainder; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def placed(rows: DataFrame, group: str, order: list[str], parts: int, name: str) -> DataFrame:
    """rows with their place in their group by these columns (pos), the group's size (n) and the partition of neighbours that holds them (part).

    Rows are dealt by ranges, wherever a group ends, and counted by range, so that no group is gathered. Rows that are equal in group and order may change places: a salt splits even those.
    """
    keys = [group, *order, "_salt"]
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    held = written(dealt.drop("_salt").withColumn("_at", F.monotonically_increasing_id()), name)
    held = held.withColumn("part", F.shiftright("_at", 33))
    counts = held.groupBy("part", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(group)
    before = (F.sum("_n").over(own.orderBy("part")) - F.col("_n")).alias("_before")
    counts = counts.select("part", group, "_first", before, F.sum("_n").over(own).alias("n"))
    return held.join(counts, ["part", group]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Alternates two contractions on the edge list until it no longer changes: each node's larger neighbours are tied to the
    smallest of its neighbourhood, then each node's smaller neighbours. Only minima by node are gathered, so that a node with very many
    links costs a partial aggregate and a join, never a list.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-links")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "component-links")
        release(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
