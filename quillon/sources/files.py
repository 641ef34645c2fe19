"""Readers and writers of catalogue data."""

from __future__ import annotations

import csv
import html as html_entities
import warnings
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.clean import dedupe_first
from quillon.operators.history import last_n
from quillon.schema import CATALOGUE, HISTORY
from quillon.sources import buckets
from quillon.sources.scratch import scratch  # noqa: F401 - part of this module's interface

#: Cells that mean missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def csv_headers(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, first line) of the CSV files of a folder, in order of name. Only the beginning of each is read, by the driver through Spark's file systems; a file that cannot be opened, or is empty, is named in a warning and left out."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for top in store.globStatus(where) or []:
        inner = store.listStatus(top.getPath()) if top.isDirectory() else [top]
        found += [s.getPath() for s in inner if s.isFile() and s.getPath().getName().endswith(".csv")]

    def head(file) -> tuple[str, str]:
        try:
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(store.open(file), "UTF-8"))
            try:
                line = reader.readLine()
            finally:
                reader.close()
        except Py4JJavaError as e:
            line = None
            warnings.warn(f"skipped {file.toString()}: {e.java_exception}", stacklevel=2)
        if line == "":
            warnings.warn(f"skipped {file.toString()}: no header", stacklevel=2)
        return file.toString(), (line or "").lstrip("\ufeff")

    with ThreadPoolExecutor(16) as pool:
        return [(f, line) for f, line in sorted(pool.map(head, found)) if line]


def read_catalogue_csv(spark: SparkSession, path: str, na_tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """Every CSV of a folder, joined by column name; _file and _pos give the read order (A1).

    Files are grouped by their header line, of which only the beginning of a file is read, and each group is read at once. Missing columns and cells are empty; unreadable files are skipped.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, head in csv_headers(spark, path):
        groups.setdefault(tuple(next(csv.reader([head]))), []).append(file)
    out = None
    for names, files in sorted(groups.items()):
        reader = spark.read.options(header=True, multiLine=True, escape='"', ignoreCorruptFiles=True).schema(", ".join(f"`{n}` string" for n in names))
        part = reader.csv(sorted(files)).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_pos"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no CSV files: {path}")
    data = [c for c in out.columns if c not in ("_file", "_pos")]
    return out.select(*[F.when(F.col(f"`{c}`").isin(*na_tokens) | F.col(f"`{c}`").isNull(), "").otherwise(F.col(f"`{c}`")).alias(c) for c in data], "_file", "_pos")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"))


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """(link, file_name) of the first named link of each line, entities decoded; the last line of a link counts (A2)."""
    pattern = r'HREF="(.*?)".*?>(.*?)</A>'
    found = _lines(spark, path).where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("link"), F.regexp_extract("value", pattern, 2).alias("name"), F.struct("file", "line_no").alias("at"))

    def decode(names: pd.Series) -> pd.Series:
        return names.map(html_entities.unescape)

    return found.groupBy("link").agg(F.max_by("name", "at").alias("name")).select("link", F.pandas_udf(decode, "string")("name").alias("file_name"))


def read_link_list(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(line_no, link): the first link of each line that has one, in order, repeats kept (A3)."""
    found = _lines(spark, path).select("line_no", F.regexp_extract("value", pattern, 0).alias("link"))
    return found.where("link <> ''").orderBy("line_no")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(value): the whole text of a file, or no row if it is missing."""
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "value string")


def read_word_set(spark: SparkSession, path: str, quotes: str = "single") -> DataFrame:
    """(term): distinct quoted strings of a file: in single quotes, maybe empty and within a line, or in either quotes and not empty (A4)."""
    one, both = r"(?d)'(.*?)'", r"""(?s)["'](.+?)["']"""
    found = F.regexp_extract_all("value", F.lit(one if quotes == "single" else both), F.lit(1))
    return _whole(spark, path).select(F.explode(found).alias("term")).distinct()


def read_semantic_map(spark: SparkSession, path: str) -> DataFrame:
    """(term, mapped, pos) of a flat JSON object in order of keys; of a repeated key the last value counts (A5)."""
    parsed = _whole(spark, path).select(F.from_json("value", "map<string,string>").alias("m"))
    pairs = parsed.select(F.posexplode("m").alias("pos", "term", "mapped"))
    return pairs.groupBy("term").agg(F.max_by("mapped", "pos").alias("mapped"), F.min("pos").alias("pos"))


def read_catalogue(spark: SparkSession, path: str, require_id: bool = False, jdbc: dict[str, str] | None = None) -> DataFrame:
    """The whole catalogue without nulls, from Parquet or, with options, over JDBC."""
    df = spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)
    df = df.select(*[T.filled(F.col(c).cast("string")).alias(c) for c in df.columns if c in CATALOGUE], *[c for c in df.columns if c not in CATALOGUE])
    return df.where("id <> ''") if require_id else df


def write_catalogue(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Replace the table at a path by rows of unique id; with an order the first row of an id stays."""
    rows = dedupe_first(df, "id", order).select(*CATALOGUE) if order else df.select(*CATALOGUE)
    if not order and not rows.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("ids repeat")
    rows.write.mode("overwrite").parquet(path)


def upsert_catalogue(current: DataFrame, batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows of the batch, and current rows of other ids.

    Of batch rows that repeat an id the last in the order of these columns stays, by default the one of greatest cells; rows without id all stay.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in current.columns]
    one = batch.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*current.columns), F.struct(*[F.col(c) for c in order or []], *cells)).alias("row")).select("row.*")
    batch = one.unionByName(batch.where("id IS NULL").select(*current.columns))
    return current.join(batch.select("id"), "id", "left_anti").select(*current.columns).unionByName(batch.select(*current.columns))


def upsert_buckets(batch: DataFrame, path: str, order: list[str] | None = None, number: int = 64) -> int:
    """upsert_catalogue() of a table kept in hash buckets of id at a path: only the buckets that the batch has ids of are read and written, the others' files stay as they are."""

    def combine(current: DataFrame | None, rows: DataFrame) -> DataFrame:
        return upsert_catalogue(rows.select(*CATALOGUE).limit(0) if current is None else current, rows, order).select(*CATALOGUE)

    return buckets.merge(batch, path, "id", combine, number)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The whole table that upsert_buckets() keeps at a path."""
    found = buckets.read(spark, path)
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in CATALOGUE)) if found is None else found


def read_history(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """The newest n entries of a JSON list; none if it is missing or malformed."""
    try:
        rows = spark.read.schema(HISTORY).json(path, multiLine=True, mode="DROPMALFORMED")
    except AnalysisException:
        return spark.createDataFrame([], HISTORY)
    return last_n(rows.where("opened_at IS NOT NULL"), n)


def write_history(df: DataFrame, path: str, n: int = 50) -> None:
    """Keep the newest n entries at a path that is not the one they come from."""
    newest = last_n(df, n)
    entries = F.sort_array(F.collect_list(F.struct("opened_at", *[c for c in newest.columns if c != "opened_at"])))  # n at most
    newest.agg(F.to_json(entries)).write.mode("overwrite").text(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """(id, embedding) to Parquet; the last row of an id in order of pos counts (A10)."""
    rows = df.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), "pos")
    rows.groupBy("id").agg(F.max_by("embedding", "pos").alias("embedding")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) (A10)."""
    return spark.read.parquet(path).select("id", "embedding")


#: Extensions of images.
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp")


def list_images(spark: SparkSession, dirs: list[str], content: bool = False, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """Manifest of the images below folders: path, source (the folder's name), name, item_id (stem), size, mtime_ns; in order of path."""
    out = None
    for folder in dirs:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        rows = files.where(F.lower("path").rlike(rf"\.({'|'.join(extensions)})$")).select(
            "path", F.lit(folder.rstrip("/").rpartition("/")[2]).alias("source"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("item_id"),
            F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), *(["content"] if content else []),
        )
        out = rows if out is None else out.unionByName(rows)
    return out if content else out.orderBy("source", "path")


def export_term_report(df: DataFrame, path: str) -> None:
    """(feature, freq) as one CSV, most frequent first (A12); a report is as long as a vocabulary."""
    df.orderBy(F.col("freq").desc(), "feature").coalesce(1).write.mode("overwrite").csv(path, header=True)


def failed_pages(log_lines: DataFrame, pattern: str) -> DataFrame:
    """(page, first_line) of distinct page numbers in log lines (line_no, value), in order of first mention."""
    found = log_lines.select("line_no", F.regexp_extract("value", pattern, 1).alias("p")).where("p <> ''")
    return found.groupBy(F.col("p").cast("int").alias("page")).agg(F.min("line_no").alias("first_line")).orderBy("first_line")


#: Page numbers in the two kinds of crawl logs.
FAILED_PATTERNS = (r"\[页数: (\d+)", r"\[第(\d+)页")
