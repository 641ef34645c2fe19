"""Order, pages and top lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillon.operators.history import history_counts
from quillon.sources.scratch import scratch


def sort_order(by: str = "score", ascending: bool = False) -> list[Column]:
    """By score, ties by upload date from the newest; by another column alone; id last."""
    first = F.col(by).asc() if ascending else F.col(by).desc()
    return [first, F.col("upload_date").desc(), F.col("id")] if by == "score" else [first, F.col("id")]


def sort_catalogue(df: DataFrame, by: str = "score", ascending: bool = False) -> DataFrame:
    """Rows in order (G1)."""
    return df.orderBy(*sort_order(by, ascending))


@dataclass
class StoredOrder:
    """Rows in an order, written once: range partitions (_part) with the place of each row in its own (_nth), and how many rows each holds."""

    rows: DataFrame
    parts: list[tuple[int, int]]

    def count(self) -> int:
        return sum(n for _, n in self.parts)

    def slice(self, start: int, end: int) -> DataFrame:
        """Rows at places start to end of the order, in order, read from the partitions that hold them."""
        wanted, held, before = F.lit(False), [], 0
        for part, n in self.parts:
            low, high = max(start - before, 0), min(end - before, n)
            if low < high:
                held.append(part)
                wanted = wanted | ((F.col("_part") == part) & (F.col("_nth") >= low) & (F.col("_nth") < high))
            before += n
        return self.rows.where(F.col("_part").isin(held) & wanted).orderBy("_part", "_nth").drop("_part", "_nth")

    def page(self, page_index: int, size: int = 500) -> DataFrame:
        """Rows page_index * size and on (G2): no partition before them is read."""
        return self.slice(page_index * size, (page_index + 1) * size)

    def placed(self) -> DataFrame:
        """All rows with their place from 1; the number of rows before each partition is joined by partition."""
        before, offsets = 0, []
        for part, n in self.parts:
            offsets.append((part, before))
            before += n
        known = self.rows.sparkSession.createDataFrame(offsets, "_part int, _before long")
        return self.rows.join(known, "_part").withColumn("place", F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_before")


def open_order(spark: SparkSession, path: str) -> StoredOrder:
    """An order that store_order() has finished at a path."""
    parts = sorted((r[0], r[1]) for r in spark.read.parquet(f"{path}/parts").collect())  # one row a partition
    schema = spark.read.parquet(f"{path}/shape").schema.add("_part", IntegerType())
    rows = spark.read.schema(schema).parquet(f"{path}/rows") if parts else spark.createDataFrame([], schema)
    return StoredOrder(rows, parts)


def store_order(df: DataFrame, order: list[Column], path: str | None = None) -> StoredOrder:
    """Sort df once by range and keep it at a path, by default one that goes with the application. The table of parts comes last: an order without it is not finished."""
    spark = df.sparkSession
    path = path or scratch(spark, "order")
    at = F.monotonically_increasing_id()
    held = df.orderBy(*order).withColumn("_nth", at.bitwiseAND(F.lit((1 << 33) - 1))).withColumn("_part", F.spark_partition_id())
    held.write.mode("overwrite").partitionBy("_part").parquet(f"{path}/rows")
    held.drop("_part").limit(0).write.mode("overwrite").parquet(f"{path}/shape")
    shape = held.schema
    spark.read.schema(shape).parquet(f"{path}/rows").groupBy("_part").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/parts")
    return open_order(spark, path)


def with_place(df: DataFrame, by: str = "score", ascending: bool = False) -> DataFrame:
    """All rows with their place from 1 in the order of sort_catalogue, from an order stored once."""
    return store_order(df, sort_order(by, ascending)).placed()


def page(df: DataFrame, order: list[Column], page_index: int, size: int = 500) -> DataFrame:
    """Rows page_index * size and on of the order (G2), for a single look: Spark keeps the rows up to the page's end in each partition. Repeated and deep looks are cheaper in a StoredOrder."""
    return df.orderBy(*order).offset(page_index * size).limit(size)


def page_ranges(df: DataFrame, size: int = 500) -> DataFrame:
    """(page_index, label) of all pages of a result."""
    n = df.agg(F.count("*").alias("n"))
    pages = n.where("n > 0").select("n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / size).cast("int"))).alias("page_index"))
    start = F.col("page_index") * size
    return pages.select("page_index", F.format_string("%d ~ %d", start.cast("long"), F.least(start + size, F.col("n")) - 1).alias("label"))


def top_features(freq: DataFrame, n: int = 15) -> DataFrame:
    """The n most frequent features, ties by name."""
    return freq.orderBy(F.col("freq").desc(), "feature").limit(n)


def history_top_features(history: DataFrame, facet: str, n: int = 15) -> DataFrame:
    """The n features of a facet that most entries of the history have."""
    counts = history_counts(history).where(F.col("facet") == facet).select("feature", F.col("n").alias("freq"))
    return top_features(counts, n)
