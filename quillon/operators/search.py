"""Keyword search over stored blocks of items, by postings of trigrams.

A term that occurs in a text has all its trigrams there, so a block of items none of which has one of them cannot hold the term. Postings tell in which blocks a trigram occurs;
a query reads the blocks that have all trigrams of all its terms, and checks their rows exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillon.operators.filters import keyword_search, query_terms
from quillon.sources.scratch import scratch

#: Characters of a gram; rows of a block, about; blocks that a plan lists one by one at most.
GRAM, ROWS, LISTED = 3, 50_000, 1_000


def grams(term: str) -> set[str]:
    """The trigrams of a term; a shorter one has none."""
    return {term[i : i + GRAM] for i in range(len(term) - GRAM + 1)}


@dataclass
class SearchIndex:
    rows: DataFrame  # items with _block
    postings: DataFrame  # (gram, _block), each once

    def blocks(self, query: str) -> DataFrame | None:
        """(_block): the blocks that have every trigram of the query; None where it has none to go by."""
        wanted = sorted(set().union(*[grams(t) for t in query_terms(query)]))
        if not wanted:
            return None
        return self.postings.where(F.col("gram").isin(wanted)).groupBy("_block").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("_block")

    def search(self, query: str) -> DataFrame:
        """Rows whose search_text holds every term (E4): the same as keyword_search() of all rows."""
        blocks, rows = self.blocks(query), self.rows
        if blocks is not None:
            found = [r[0] for r in blocks.limit(LISTED + 1).collect()]
            rows = rows.where(F.col("_block").isin(found)) if len(found) <= LISTED else rows.join(blocks, "_block", "left_semi")
        return keyword_search(rows, query).drop("_block")


def open_search(spark: SparkSession, path: str) -> SearchIndex:
    schema = spark.read.parquet(f"{path}/shape").schema.add("_block", IntegerType())
    return SearchIndex(spark.read.schema(schema).parquet(f"{path}/rows"), spark.read.schema("gram string, _block int").parquet(f"{path}/postings"))


def store_search(items: DataFrame, path: str | None = None, order: tuple[str, ...] = ("author", "title", "id"), rows: int = ROWS) -> SearchIndex:
    """Keep items (with search_text) in blocks of neighbours by these columns, and the postings of their trigrams, sorted by gram, at a path or until the application ends.

    The more alike a block's rows are, the fewer blocks a term is in. Postings are made distinct within each task before they are shuffled.
    """
    path = path or scratch(items.sparkSession, "search")
    held = items.repartitionByRange(items.count() // rows + 1, *order, "search_text").withColumn("_block", F.spark_partition_id())
    held.write.mode("overwrite").partitionBy("_block").parquet(f"{path}/rows")
    items.limit(0).write.mode("overwrite").parquet(f"{path}/shape")
    spark = items.sparkSession
    text = spark.read.schema(held.schema).parquet(f"{path}/rows").select("_block", "search_text")
    every = F.transform(F.sequence(F.lit(1), F.length("search_text") - GRAM + 1), lambda i: F.substring("search_text", i, F.lit(GRAM)))
    pairs = text.where(F.length("search_text") >= GRAM).select("_block", F.explode(F.array_distinct(every)).alias("gram")).distinct()
    pairs.select("gram", "_block").sort("gram", "_block").write.mode("overwrite").parquet(f"{path}/postings")
    return open_search(spark, path)
