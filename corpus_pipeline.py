"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, langid, mixing, near, secret_scan
from quillon.llm.common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter; those without one, or without text, go, by the `und` rule alone, whatever languages were learned."""
    model = langid.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    return langid.keep_identified(docs, model)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def keyed(docs: DataFrame, row: str) -> DataFrame:
    """docs with a key of its own for every row, written once so that the keys stand."""
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, by five-word shingles at 0.8: the one of smallest doc_id, null last; each row decides for itself, whatever its doc_id."""
    row = unused(docs, "_row")
    rows = keyed(docs, row)
    groups = near.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), width=5, percent=80).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*docs.columns).alias("content"), F.col(row).alias("row"))
    best = rows.select(row, order.alias("o")).join(groups.hint("shuffle_hash"), row).groupBy("component_id").agg(F.min("o").alias("o"))
    found = written(best.select(F.col("o.row").alias(row)), "pipeline-kept")
    return rows.join(found.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret found; n_chars follows the text."""
    found, _ = secret_scan.scan_versions(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    blob, spans, clean_text = (unused(docs, name) for name in ("_blob", "_spans", "_clean"))
    blobs = found.where(F.size("findings") > 0).select(F.col("blob_id").alias(blob), F.col("findings").alias(spans)).dropDuplicates([blob])
    blobs = written(blobs, "pipeline-secrets")

    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, findings in batches:
            yield pd.Series([t if f is None or not len(f) else secret_scan.redact(t, f) for t, f in zip(texts, findings, strict=True)], dtype=object)

    held = docs.withColumn(blob, secret_scan.blob_id(F.coalesce("text", F.lit("")))).join(blobs, blob, "left")
    marked = F.when(F.col(spans).isNotNull(), F.col("text"))  # texts without findings do not go to the helper
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.pandas_udf(clean, "string")(marked, spans))
    held = held.withColumn(clean_text, text)
    chars = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(clean_text))
    return held.withColumn("n_chars", chars.cast("long")).withColumn("text", F.col(clean_text)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as many times as the mix takes it, whatever its doc_id; the order of rounding is that of the rows' content, so that reruns agree."""
    row, times, copy = (unused(docs, name) for name in ("_row", "_copies", "_copy"))
    rows = keyed(docs, row)
    copies = mixing.mix(rows.select(F.xxhash64(*docs.columns).alias("doc_id"), "source", "text", row), row=row)
    taken = written(copies.where("copies > 0").select(row, F.col("copies").cast("int").alias(times)), "pipeline-copies")
    return rows.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, written here, so that whole texts go to the helpers in small batches whatever the session's settings are when the result is read."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return written(coded.select("doc_id", "n_tokens", bpe.token_ids("ids").alias("ids")), "pipeline-encoded")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the language machines nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else written(out, f"pipeline-stage{k + 1}")
    return docs
