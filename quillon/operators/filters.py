"""Filters over scored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.sources.scratch import stored, unused, with_handle


def block_tags(df: DataFrame, blocked: list[str]) -> DataFrame:
    """Rows without any blocked tag (E1); a null tag, or no list of tags, is not blocked."""
    if not blocked:
        return df
    return df.where(~F.coalesce(F.arrays_overlap("parsed_tags", F.array(*[F.lit(x) for x in blocked])), F.lit(False)))


def block_tags_joined(df: DataFrame, blocked: DataFrame) -> DataFrame:
    """The same for a block list of any size (tag), as a table; each row is judged by its own tags, whatever its id."""
    row = unused(df, "_row")
    held = with_handle(df, row)
    hit = held.select(row, F.explode("parsed_tags").alias("tag")).join(blocked.select("tag"), "tag", "left_semi").select(row).distinct()
    return held.join(hit, row, "left_anti").drop(row)


def score_bounds(df: DataFrame) -> DataFrame:
    """One row: least and largest score (0 and 100 without rows; the largest is above the least), and the default threshold."""
    low, high = F.coalesce(F.min("score"), F.lit(0)), F.coalesce(F.max("score"), F.lit(100))
    bounds = df.agg(low.alias("low"), high.alias("high")).withColumn("high", F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1))
    return bounds.withColumn("threshold", F.when((F.col("low") <= 0) & (F.col("high") >= 0), 0).otherwise(F.col("low")))


def min_score(df: DataFrame, threshold: int | None = None) -> DataFrame:
    """Rows at or above the threshold, by default that of score_bounds (E3). Bounds and rows are then read from one stored table, so that nothing is scored twice."""
    if threshold is None:
        df = stored(df, "scored")
        threshold = score_bounds(df).first()["threshold"]
    return df.where(F.col("score") >= threshold)


def query_terms(query: str) -> list[str]:
    """Comma terms of a query, full-width commas included, stripped and lowered, blanks dropped."""
    return [t for t in (x.strip().lower() for x in query.replace("，", ",").split(",")) if t]


def keyword_search(df: DataFrame, query: str) -> DataFrame:
    """Rows whose search_text holds every term."""
    return reduce(lambda d, t: d.where(F.col("search_text").contains(t)), query_terms(query), df)


def keyword_search_columns(df: DataFrame, query: str, cols: tuple[str, ...] = ("id", "title", "tags", "author", "team")) -> DataFrame:
    """Rows of which some column holds each term (E5)."""

    def anywhere(term: str) -> Column:
        return reduce(lambda a, b: a | b, [F.lower(T.filled(F.col(c))).contains(term) for c in cols])

    return reduce(lambda d, t: d.where(anywhere(t)), query_terms(query), df)
