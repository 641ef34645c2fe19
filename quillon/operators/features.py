"""Features of catalogue items: parsed tags, title words, and how often they occur."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.clean import title_fallback
from quillon.sources.scratch import unused, with_handle

#: Dictionaries up to this many entries become a map literal in the plan; larger ones are joined.
LITERAL = 10_000


def _mapped(values: Column, mapping: dict[str, str]) -> Column:
    if not mapping:
        return values
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.transform(values, lambda x: F.coalesce(table[x], x))


def _without(values: Column, stop: set[str]) -> Column:
    return F.filter(values, lambda x: ~x.isin(*sorted(stop))) if stop else values


def parse_tags(df: DataFrame, stop_tags: set[str], semantic_map: dict[str, str]) -> DataFrame:
    """parsed_tags: comma pieces, stripped, without stop tags, then mapped; repeats and blank pieces stay."""
    if len(stop_tags) > LITERAL or len(semantic_map) > LITERAL:
        spark = df.sparkSession
        stops = spark.createDataFrame([(x,) for x in stop_tags], "term string")
        maps = spark.createDataFrame(list(semantic_map.items()), "term string, mapped string")
        return parse_tags_joined(df, stops, maps)
    return df.withColumn("parsed_tags", _mapped(_without(T.split_raw(F.col("tags")), stop_tags), semantic_map))


def parse_tags_joined(df: DataFrame, stop_tags: DataFrame, semantic_map: DataFrame) -> DataFrame:
    """The same with dictionaries of any size as tables (term) and (term, mapped): pieces meet them in joins and go back, in order, to the row that they came from."""
    row = unused(df, "_row")
    held = with_handle(df.drop("parsed_tags"), row)
    pieces = held.select(row, F.posexplode(T.split_raw(F.col("tags"))).alias("pos", "term"))
    kept = pieces.join(stop_tags.select("term").distinct(), "term", "left_anti").join(semantic_map.select("term", "mapped"), "term", "left")
    kept = kept.select(row, F.struct("pos", F.coalesce("mapped", "term").alias("tag")).alias("x"))
    back = kept.groupBy(row).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["tag"]).alias("parsed_tags"))
    return held.join(back, row, "left").withColumn("parsed_tags", F.coalesce("parsed_tags", F.array().cast("array<string>"))).drop(row)


def tokenize_titles(df: DataFrame, tokenizer: Callable[[str], list[tuple[str, str]]] | None = None, strip_parens: bool = False) -> DataFrame:
    """tokens array<struct<surface,pos>> of the title without [..] (and (..)) parts.

    The default splits at everything but letters and digits and calls each piece a noun; a tokenizer of the caller runs in Arrow batches.
    """
    plain = F.regexp_replace(T.filled(F.col("title")), r"(?d)\[.*?\]", "")
    if strip_parens:
        plain = F.regexp_replace(plain, r"(?d)\(.*?\)", "")
    plain = T.strip(plain)
    if tokenizer is None:
        pieces = F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda x: x != "")
        return df.withColumn("tokens", F.transform(pieces, lambda x: F.struct(x.alias("surface"), F.lit("noun").alias("pos"))))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for titles in batches:
            seen: dict[str, list[dict[str, str]]] = {}
            for t in set(titles):
                seen[t] = [{"surface": s, "pos": p} for s, p in tokenizer(t)]
            yield titles.map(seen)

    return df.withColumn("tokens", F.pandas_udf(run, "array<struct<surface:string,pos:string>>")(plain))


def title_words(df: DataFrame, stop_words: set[str], semantic_map: dict[str, str], pos_keep: tuple[str, ...] = ("noun", "verb", "adjective")) -> DataFrame:
    """title_words: surfaces of kept word classes that are not stop words, mapped."""
    kept = F.filter("tokens", lambda t: t["pos"].isin(*pos_keep) & (F.length(t["surface"]) >= 1))
    return df.withColumn("title_words", _mapped(_without(F.transform(kept, lambda t: t["surface"]), stop_words), semantic_map))


def feature_counts(df: DataFrame, array_col: str) -> DataFrame:
    """(id, feature, cnt, norm): how often an item has a feature, and the root of its number of features (C4).

    An item's features lie in one row, so they are counted inside the array and nothing is shuffled.
    """
    counted = F.transform(F.array_distinct(array_col), lambda x: F.struct(x.alias("feature"), F.size(F.filter(array_col, lambda y: y == x)).cast("long").alias("cnt")))
    norm = F.sqrt(F.greatest(F.size(array_col), F.lit(1)).cast("double"))
    return df.select("id", norm.alias("norm"), F.explode(counted).alias("c")).select("id", "c.feature", "c.cnt", "norm")


def array_frequency(df: DataFrame, array_col: str) -> DataFrame:
    """(feature, freq) over all rows, repeats counted."""
    return df.select(F.explode(array_col).alias("feature")).groupBy("feature").agg(F.count("*").alias("freq"))


def author_frequency(df: DataFrame) -> DataFrame:
    """(feature, freq) of stripped author texts that are not blank."""
    return df.select(T.strip(T.filled(F.col("author"))).alias("feature")).where("feature <> ''").groupBy("feature").agg(F.count("*").alias("freq"))


def base_scores(freq: DataFrame) -> DataFrame:
    """(feature, freq, base): ten times the logarithm of one more than the frequency."""
    return freq.withColumn("base", F.log1p("freq") * 10)


def unmapped_tags(df: DataFrame, semantic_map: DataFrame) -> DataFrame:
    """Distinct raw tags that are not keys of the map (term), sorted, with how many there are."""
    tags = df.select(F.explode(T.split_items(F.col("tags"))).alias("tag")).distinct()
    left = tags.join(semantic_map.select(F.col("term").alias("tag")).distinct(), "tag", "left_anti")
    return left.crossJoin(left.agg(F.count("*").alias("n_unmapped"))).orderBy("tag")  # one row


def title_word_report(df: DataFrame, stop_words: set[str], semantic_map: dict[str, str]) -> DataFrame:
    """(feature, freq) of the words of titles, most frequent first."""
    words = title_words(tokenize_titles(title_fallback(df, "strip"), strip_parens=True), stop_words, semantic_map)
    return array_frequency(words, "title_words").orderBy(F.col("freq").desc(), "feature")


def disambiguate_map(semantic_map: DataFrame) -> DataFrame:
    """(term, mapped, pos) where each mapped value names the first key that maps to it."""
    first = F.first("term").over(Window.partitionBy("mapped").orderBy("pos"))
    return semantic_map.select("term", F.concat("mapped", F.lit("("), first, F.lit(")")).alias("mapped"), "pos")


def facet_values(freq: DataFrame) -> DataFrame:
    """Sorted distinct values of a facet (C11)."""
    return freq.select("feature").distinct().orderBy("feature")


def catalogue_metrics(filtered: DataFrame, authors: DataFrame, tags: DataFrame, words: DataFrame) -> DataFrame:
    """One row: rows shown, number of authors, tags and title words."""
    counts = [filtered.agg(F.count("*").alias("n_items"))]
    counts += [f.agg(F.countDistinct("feature").alias(n)) for f, n in ((authors, "n_authors"), (tags, "n_tags"), (words, "n_title_words"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out


#: Registers of a sketch, as a power of two: counts are off by 1.04 / sqrt(2 ** 14), 0.8 %, as a standard error.
SKETCH = 14


def facet_sketches(items: DataFrame, *keys: str) -> DataFrame:
    """(keys, facet, n_rows, sketch): mergeable sketches of the distinct tags, authors and title words of items, all in one pass, by any keys such as a bucket."""

    def named(values: Column, facet: str) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("feature")))

    author = F.filter(F.array(T.strip(T.filled(F.col("author")))), lambda x: x != "")
    row = F.array(F.struct(F.lit("row").alias("facet"), F.lit("").alias("feature")))
    every = F.concat(named(F.col("parsed_tags"), "tag"), named(author, "author"), named(F.col("title_words"), "title_word"), row)
    found = items.select(*keys, F.explode(every).alias("f")).select(*keys, "f.facet", "f.feature")
    return found.groupBy(*keys, "facet").agg(F.count("*").alias("n_rows"), F.hll_sketch_agg("feature", SKETCH).alias("sketch"))


def approximate_metrics(sketches: DataFrame) -> DataFrame:
    """One row: rows, and about how many authors, tags and title words, from facet_sketches() of any parts, merged."""

    def about(facet: str) -> Column:
        of = F.col("facet") == facet
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.when(of, F.col("sketch")))), F.lit(0)).cast("long")

    rows = F.coalesce(F.sum(F.when(F.col("facet") == "row", F.col("n_rows"))), F.lit(0)).cast("long")
    return sketches.agg(rows.alias("n_items"), about("author").alias("n_authors"), about("tag").alias("n_tags"), about("title_word").alias("n_title_words"))
