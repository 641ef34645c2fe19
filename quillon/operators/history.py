"""History of opened items, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T


def _distinct_items(values: Column) -> Column:
    """Stripped items that are not blank, in order, each once."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), T.strip), lambda x: x != ""))


def _as_list(df: DataFrame, name: str) -> Column:
    """A list column, or a comma text as a list."""
    return T.split_items(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name)


def history_entries(opens: DataFrame, items: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """An entry for each of opens (opened_at, action, id) of an item (H1).

    items has id, title, author, link, local_path, and parsed_tags and title_words as lists or comma texts. Items without id and title make no entry. `keep` names
    further columns of opens to carry along.
    """
    own = items.select("id", *[T.strip(T.filled(F.col(c))).alias(c) for c in ("title", "author", "link", "local_path")], _distinct_items(_as_list(items, "parsed_tags")).alias("tags"), _distinct_items(_as_list(items, "title_words")).alias("title_words"))
    both = opens.select("opened_at", "action", "id", *keep).join(own, "id")
    both = both.withColumn("id", T.strip(F.col("id"))).where((F.col("id") != "") | (F.col("title") != ""))
    return both.select("opened_at", "action", "id", "title", "author", "link", "local_path", "tags", "title_words", *keep)


def item_token(df: DataFrame) -> Column:
    """The token of an item in tracked links: its id, or a digest of title, link and folder if it has none (H2)."""
    item = T.strip(T.filled(F.col("id")))
    return F.when(item != "", item).otherwise(F.md5(F.concat_ws("\n", *[T.filled(F.col(c)) for c in ("title", "link", "local_path")])))


def click_log_entries(requests: DataFrame, items: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(opened_at, token, known, action, redirect, id, ...) of requests (opened_at, path) to /open (H2).

    A known token makes an entry even where the redirect is invalid (null): redirect is the target if it is a web link, else the item's link if that is one.
    Entries are the rows where known is true.
    """
    parsed = requests.where(F.regexp_extract("path", "^([^?#]*)", 1) == "/open")

    def query(name: str) -> Column:
        return F.coalesce(F.try_url_decode(F.regexp_extract("path", rf"[?&]{name}=([^&#]*)", 1)), F.lit(""))

    asked = parsed.select("opened_at", query("token").alias("token"), query("target").alias("target"), *keep)
    # of items that share a token the least by its cells stands for all
    known = items.select(item_token(items).alias("token"), F.struct("id", "title", "author", "link").alias("item")).groupBy("token").agg(F.min("item").alias("item")).select("token", "item.*")
    both = asked.join(known.withColumn("known", F.lit(True)), "token", "left")
    redirect = F.when(T.is_web_link(F.col("target")), F.col("target")).when(T.is_web_link(F.col("link")), T.strip(F.col("link")))
    found = F.coalesce("known", F.lit(False))
    return both.select("opened_at", "token", found.alias("known"), F.when(found, F.lit("network_link")).alias("action"), redirect.alias("redirect"), "id", "title", "author", *keep)


def last_n(history: DataFrame, n: int = 50, key: str | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    """The n newest entries, or the n newest of each key (H3). No entry without id and title; none at all for n <= 0."""
    real = history.where((T.filled(F.col("id")) != "") | (T.filled(F.col("title")) != ""))
    order = [F.col("opened_at").desc(), *[F.col(c).desc() for c in tie]]
    if n <= 0:
        return real.where("false")
    if key is None:
        return real.orderBy(*order).limit(n)
    return real.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def history_counts(history: DataFrame) -> DataFrame:
    """(facet, feature, n): entries that have each tag and each title word, and entries of each author that is not blank (H4)."""

    def listed(column: str, facet: str) -> DataFrame:
        return history.select(F.lit(facet).alias("facet"), F.explode(_distinct_items(F.col(column))).alias("feature"))

    authors = history.select(F.lit("author").alias("facet"), T.strip(T.filled(F.col("author"))).alias("feature")).where("feature <> ''")
    return listed("tags", "tag").unionByName(listed("title_words", "title_word")).unionByName(authors).groupBy("facet", "feature").agg(F.count("*").alias("n"))
