"""Rows for a language model's context, and its transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Rows in a context at most.
MOST = 500
#: Fixed value: heading of a context.
HEADING = "### 当前选中的参考库存数据：\n"


def sample_context(df: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """n rows (at most MOST) by hash of id and seed, without replacement."""
    return df.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max(0, min(n, MOST)))


def format_context(df: DataFrame) -> DataFrame:
    """One row: heading and a line for each of a context's rows, by score then id; empty text without rows."""
    line = F.format_string("- ID: %s | 标题: %s | 作者: %s | 标签: %s | 评分: %s | 链接: %s\n", *[F.col(c).cast("string") for c in ("id", "title", "author", "tags", "score", "link")])
    lines = df.select((-F.col("score")).alias("s"), "id", line.alias("line"))
    joined = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "id", "line"))), lambda x: x["line"]), "").alias("body"))  # MOST rows at most
    return joined.select(F.when(F.col("body") == "", "").otherwise(F.concat(F.lit(HEADING), "body")).alias("context"))


def split_reasoning(df: DataFrame, col: str) -> DataFrame:
    """think and answer of a model's reply."""
    raw = T.filled(F.col(col))
    text = F.replace(raw, F.lit("Thinking Process:"), F.lit("<think>"))
    opened, closed = text.contains("<think>"), text.contains("</think>")
    head = T.strip(F.replace(F.split_part(text, F.lit("</think>"), F.lit(1)), F.lit("<think>"), F.lit("")))
    return df.withColumns({
        "think": F.when(~opened, "").otherwise(head),
        "answer": F.when(~opened, raw).when(closed, T.strip(F.split_part(text, F.lit("</think>"), F.lit(2)))).otherwise(""),
    })
