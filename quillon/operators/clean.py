"""Cleaning projections over catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.schema import CATALOGUE

#: Language tags of the crawler and of the clean-up tool.
CRAWLER_LANGUAGES = ("中文", "英文", "日文")
TOOL_LANGUAGES = ("英文", "日文")


def title_fallback(df: DataFrame, blank: str = "exact") -> DataFrame:
    """Title is the file name where it is empty, or (blank='strip') has white space only."""
    own = T.filled(F.col("title"))
    empty = (T.strip(own) if blank == "strip" else own) == ""
    return df.withColumn("title", F.when(empty, T.filled(F.col("file_name"))).otherwise(own))


def dedupe_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order.

    A partial aggregate of one struct a key: a hot key, such as the empty one, is reduced before the shuffle.
    """
    columns = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(key).agg(first.alias("r")).select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in df.columns])


def normalise_catalogue(df: DataFrame, order: list[str]) -> DataFrame:
    """The ten columns with no nulls, stripped id and link, ids from links, title fallback, one row an id (B2)."""
    if "link" not in df.columns:
        raise ValueError("no link column")
    full = df.select(*[(T.filled(F.col(c)) if c in df.columns else F.lit("")).alias(c) for c in CATALOGUE], *[F.col(c).alias(f"_{c}") for c in order])
    full = full.withColumn("link", T.strip(F.col("link")))
    full = full.withColumn("id", T.filled(T.resolve_id(F.col("id"), F.col("link"))))
    return dedupe_first(title_fallback(full), "id", [f"_{c}" for c in order]).select(*CATALOGUE)


def _in(x: Column, values: tuple[str, ...]) -> Column:
    return x.isin(*values)


def move_language_tags(df: DataFrame, languages: tuple[str, ...] = CRAWLER_LANGUAGES, all_rows: bool = True) -> DataFrame:
    """Tags that name a language go to the language column, behind those there."""
    tags = T.split_items(F.col("tags"))
    moved = F.filter(tags, lambda x: _in(x, languages))
    rest = F.array_join(F.filter(tags, lambda x: ~_in(x, languages)), ", ")
    merged = T.join_unique(F.concat(T.split_items(F.col("language")), moved))
    if all_rows:
        return df.withColumns({"tags": rest, "language": merged})
    some = F.size(moved) > 0
    return df.withColumns({"tags": F.when(some, rest).otherwise(F.col("tags")), "language": F.when(some, merged).otherwise(F.col("language"))})


def attach_file_names(df: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """File name by link from bookmarks (link, file_name), empty if none; second column (B8). Spark picks the join by the bookmarks' size."""
    named = df.drop("file_name").join(bookmarks.select("link", "file_name"), "link", "left")
    rest = [c for c in df.columns if c != "file_name"]
    return named.select(rest[0], T.filled(F.col("file_name")).alias("file_name"), *rest[1:])


def backfill_id_from_link(df: DataFrame) -> DataFrame:
    """Where id is null or empty: prefix and what follows the last /g/ or /album/, without slashes at the ends; else empty."""
    link = T.filled(F.col("link"))

    def tail(mark: str) -> Column:
        return F.regexp_replace(F.substring_index(link, mark, -1), "^/+|/+$", "")

    made = F.when(link.contains("/g/"), F.concat(F.lit("NH"), tail("/g/"))).when(link.contains("/album/"), F.concat(F.lit("JM"), tail("/album/"))).otherwise("")
    return df.withColumn("id", F.when(T.filled(F.col("id")) == "", made).otherwise(F.col("id")))


def conform_raw(df: DataFrame, source: str) -> DataFrame:
    """Ids from links for every row, id first; source 'JM' also drops file names and moves language tags and dates into form."""
    if "link" not in df.columns:
        raise ValueError("no link column")
    out = df.withColumn("id", T.filled(T.id_from_link(F.col("link"), [r for r in T.ID_RULES if r[1] == source])))
    if source == "JM":
        out = move_language_tags(out.drop("file_name")).withColumn("upload_date", T.normalise_date(F.col("upload_date")))
    return out.select("id", *[c for c in out.columns if c != "id"])


def with_search_text(df: DataFrame, cols: tuple[str, ...] = ("id", "title", "tags", "author", "team")) -> DataFrame:
    """search_text over the given columns; a missing one counts as empty."""
    return df.withColumn("search_text", T.search_text(*[F.col(c) if c in df.columns else F.lit("") for c in cols]))


def encode_covers(images: DataFrame, done_ids: DataFrame) -> DataFrame:
    """(id, data_uri) of images (path, content) whose id is not done yet.

    The join on ids comes before the content is touched; rows with content are not sorted or shuffled by it.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    item, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    named = images.select(item.alias("id"), ext.alias("ext"), "content").where(F.col("ext").isin("jpg", "jpeg", "png", "webp", "gif"))
    fresh = named.join(done_ids.select("id").distinct(), "id", "left_anti")
    mime = F.when(F.col("ext").isin("png", "webp", "gif"), F.concat(F.lit("image/"), "ext")).otherwise("image/jpeg")
    return fresh.select("id", F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64("content"), "[\r\n]", "")).alias("data_uri"))


def resolve_cover(items: DataFrame, cached: DataFrame, online: DataFrame, local: DataFrame) -> DataFrame:
    """items with cover: the first of cached, online and local images (id, data_uri) for the resolved id, else null."""
    out = items.withColumn("_id", T.resolve_id(F.col("id"), F.col("link")))
    for k, found in enumerate((cached, online, local)):
        out = out.join(found.select(F.col("id").alias("_id"), F.col("data_uri").alias(f"_c{k}")), "_id", "left")
    return out.withColumn("cover", F.coalesce("_c0", "_c1", "_c2")).select(*items.columns, "cover")
