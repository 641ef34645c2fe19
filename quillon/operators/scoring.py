"""The explainable recommendation score.

Every part is a sum of weighted features of a row. What a feature is worth, by facet, is worked out once for the vocabulary; an item's score then needs its own row and the worths of its
features, which go to all tasks while they are few (with_sum). Sums are rounded to six decimals before truncation, so that their order does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.features import base_scores
from quillon.operators.history import history_counts
from quillon.schema import SCORED
from quillon.sources.scratch import stored, unused, with_handle

TAG_WEIGHT, AUTHOR_WEIGHT, WORD_WEIGHT = 1.0, 5.0, 1.0
#: Features, and bytes of their names, that go to all tasks at most.
GATHERED, GATHERED_BYTES = 1_000_000, 32_000_000


@dataclass
class Frequencies:
    """(feature, freq) of each facet."""

    tags: DataFrame
    authors: DataFrame
    words: DataFrame
    table: DataFrame | None = None  # the same in one, (facet, feature, freq)

    def together(self) -> DataFrame:
        if self.table is not None:
            return self.table
        named = [f.select(F.lit(facet).alias("facet"), "feature", "freq") for facet, f in zip(FACETS, (self.tags, self.authors, self.words), strict=True)]
        return named[0].unionByName(named[1]).unionByName(named[2])


FACETS = ("tag", "author", "title_word")


def frequencies_by(items: DataFrame, *keys: str) -> DataFrame:
    """(keys, facet, feature, freq) of all facets, counted in one pass."""

    def named(values: Column, facet: str) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("feature")))

    own = T.strip(T.filled(F.col("author")))
    every = F.concat(named(F.col("parsed_tags"), "tag"), named(F.filter(F.array(own), lambda x: x != ""), "author"), named(F.col("title_words"), "title_word"))
    return items.select(*keys, F.explode(every).alias("f")).groupBy(*keys, "f.facet", "f.feature").agg(F.count("*").alias("freq"))


def all_frequencies(items: DataFrame) -> Frequencies:
    """Frequencies of all facets."""
    table = frequencies_by(items)
    return Frequencies(*[table.where(F.col("facet") == f).select("feature", "freq") for f in FACETS], table)


def _by_facet(values: tuple) -> Column:
    return F.when(F.col("facet") == FACETS[0], values[0]).when(F.col("facet") == FACETS[1], values[1]).otherwise(values[2])


@dataclass
class Weights:
    """(feature, weight) of each facet, or none."""

    tags: DataFrame | None = None
    authors: DataFrame | None = None
    words: DataFrame | None = None


@dataclass
class Multipliers:
    tag: float = 1.0
    author: float = 1.0
    title: float = 1.0
    history: float = 1.0


def _author() -> Column:
    return T.strip(T.filled(F.col("author")))


def _gathered(tags: Column, author: Column, words: Column, held: Broadcast) -> Column:
    """The sum of a row's worths in Arrow batches: distinct features of a batch are looked up, then gathered by their numbers in the rows' lists."""

    def sums(tags: pa.Array, author: pa.Array, words: pa.Array) -> pa.Array:
        known, n = held.value, len(author)
        total = np.zeros(n)
        for facet, lists in zip((FACETS[0], FACETS[2]), (tags, words), strict=True):
            own = lists.flatten().dictionary_encode()
            worth = np.array([*(known.get((facet, x), 0.0) for x in own.dictionary.to_pylist()), 0.0])
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            number = own.indices.fill_null(len(worth) - 1).to_numpy(zero_copy_only=False)
            total += np.bincount(np.repeat(np.arange(n), size), worth[number], n) / np.sqrt(np.maximum(size, 1))
        own = author.dictionary_encode()
        worth = np.array([known.get((FACETS[1], x), 0.0) if x else 0.0 for x in own.dictionary.to_pylist()] or [0.0])
        return pa.array(total + worth[own.indices.to_numpy(zero_copy_only=False)])

    return F.arrow_udf(sums, "double")(tags, author, words)


def _joined(items: DataFrame, worth: DataFrame, out: str) -> DataFrame:
    """The same by a join of every row's features with their worths, summed by row."""
    row = unused(items, "_row")
    held = with_handle(items, row)

    def entries(values: Column, facet: str) -> Column:
        norm = F.sqrt(F.greatest(F.size(values), F.lit(1)).cast("double"))
        return F.transform(values, lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("feature"), (1 / norm).alias("amount")))

    own = F.filter(F.array(_author()), lambda x: x != "")
    lists = [F.coalesce(c, F.array().cast("array<string>")) for c in (F.col("parsed_tags"), own, F.col("title_words"))]
    every = F.concat(*[entries(c, facet) for c, facet in zip(lists, FACETS, strict=True)])
    features = held.select(row, F.explode(every).alias("f")).select(row, "f.facet", "f.feature", "f.amount")
    features = features.groupBy(row, "facet", "feature").agg(F.sum("amount").alias("amount"))
    total = features.join(worth, ["facet", "feature"]).groupBy(row).agg(F.sum(F.col("amount") * F.col("value")).alias("_total"))
    return held.join(total, row, "left").withColumn(out, F.coalesce("_total", F.lit(0.0))).drop(row, "_total")


def with_sum(items: DataFrame, worth: DataFrame, out: str, most: int = GATHERED) -> DataFrame:
    """items with a column that sums the worths (facet, feature, value) of each row's features: of tags and title words over the root of their number, repeats counted, and of the author.

    Each row has its own sum, whatever its id. The table of worths is stored and measured: up to `most` features of bounded text go to all tasks and rows are summed where they lie, without a
    shuffle; beyond that rows and worths meet in a join. Both give the same sums up to the order of additions.
    """
    worth = stored(worth.select("facet", "feature", F.col("value").cast("double").alias("value")), "worths")
    size = worth.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("feature")), F.lit(0))).first()
    if size[0] > most or size[1] > GATHERED_BYTES:
        return _joined(items, worth, out)
    held: dict[tuple[str, str], float] = {}
    for r in worth.collect():  # measured above
        held[r[0], r[1]] = held.get((r[0], r[1]), 0.0) + r[2]
    held = items.sparkSession.sparkContext.broadcast(held)
    lists = [F.col(c).cast("array<string>") for c in ("parsed_tags", "title_words")]
    return items.withColumn(out, _gathered(lists[0], _author(), lists[1], held))


def _worth(facet: str, freq: DataFrame, weights: DataFrame | None, default: float, factor: float, amount: str = "base") -> DataFrame:
    """(facet, feature, value): amount (base or freq) by weight by factor."""
    scored = base_scores(freq)
    weight = F.lit(float(default))
    if weights is not None:
        scored = scored.join(weights.select("feature", "weight"), "feature", "left")
        weight = F.coalesce("weight", weight)
    return scored.select(F.lit(facet).alias("facet"), "feature", (F.col(amount) * weight * float(factor)).alias("value"))


def tag_score(items: DataFrame, freq: DataFrame, weights: DataFrame | None = None, g: float = 1.0, most: int = GATHERED) -> DataFrame:
    """(id, tag_score) of every row."""
    return with_sum(items, _worth(FACETS[0], freq, weights, TAG_WEIGHT, g * 0.5), "tag_score", most).select("id", "tag_score")


def author_score(items: DataFrame, freq: DataFrame, weights: DataFrame | None = None, g: float = 1.0, most: int = GATHERED) -> DataFrame:
    """(id, author_score) of every row, 0 for a blank or unknown author."""
    return with_sum(items, _worth(FACETS[1], freq, weights, AUTHOR_WEIGHT, g), "author_score", most).select("id", "author_score")


def title_score(items: DataFrame, freq: DataFrame, weights: DataFrame | None = None, g: float = 1.0, most: int = GATHERED) -> DataFrame:
    """(id, title_score) of every row (D3)."""
    return with_sum(items, _worth(FACETS[2], freq, weights, WORD_WEIGHT, g), "title_score", most).select("id", "title_score")


def history_bonus(history: DataFrame, freqs: Frequencies, scales: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(facet, feature, bonus): count in the history by rarity in the catalogue (D4). A scale of 0 or less leaves its facet out."""
    counts, out = history_counts(history), None
    for facet, freq, scale in zip(("tag", "author", "title_word"), (freqs.tags, freqs.authors, freqs.words), scales, strict=True):
        if scale <= 0:
            continue
        total = freq.agg(F.greatest(F.coalesce(F.sum("freq"), F.lit(0)), F.lit(1)).alias("total"))
        own = counts.where(F.col("facet") == facet).join(freq, "feature", "left").crossJoin(total)  # one row
        rarity = F.log1p((F.col("total") + 1) / (F.coalesce("freq", F.lit(0)) + 1))
        part = own.select(F.lit(facet).alias("facet"), "feature", (F.col("n") * rarity * float(scale)).alias("bonus"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = counts.where("false").select("facet", "feature", F.lit(0.0).alias("bonus"))
    return out


def history_score(items: DataFrame, bonus: DataFrame, g: float = 1.0, most: int = GATHERED) -> DataFrame:
    """(id, history_score) of every row, 0 where the multiplier is 0."""
    if g == 0:
        return items.select("id", F.lit(0.0).alias("history_score"))
    return with_sum(items, bonus.select("facet", "feature", (F.col("bonus") * float(g)).alias("value")), "history_score", most).select("id", "history_score")


def _finish(items: DataFrame, worth: DataFrame, most: int) -> DataFrame:
    scored = with_sum(items.drop("score"), worth, "score", most).withColumn("score", F.round("score", 6).cast("int"))
    if "upload_date" not in scored.columns:
        scored = scored.withColumn("upload_date", F.lit(""))
    order = [c for c in SCORED if c in scored.columns]
    return scored.select(*order, *[c for c in scored.columns if c not in order])


def worths(freqs: Frequencies, weights: Weights | None = None, g: Multipliers | None = None, history: DataFrame | None = None, scales=(1.0, 1.0, 1.0)) -> DataFrame:
    """(facet, feature, value): what every feature of the catalogue adds to an item's score, history included."""
    weights, g = weights or Weights(), g or Multipliers()
    values = base_scores(freqs.together())
    own = [w.select(F.lit(facet).alias("facet"), "feature", "weight") for facet, w in zip(FACETS, (weights.tags, weights.authors, weights.words), strict=True) if w is not None]
    if own:
        values = values.join(reduce(DataFrame.unionByName, own), ["facet", "feature"], "left")
    else:
        values = values.withColumn("weight", F.lit(None).cast("double"))
    value = F.col("base") * F.coalesce("weight", _by_facet((TAG_WEIGHT, AUTHOR_WEIGHT, WORD_WEIGHT))) * _by_facet((g.tag * 0.5, g.author, g.title))
    if history is not None and g.history > 0:
        values = values.join(history_bonus(history, freqs, scales), ["facet", "feature"], "left")
        value = value + F.coalesce("bonus", F.lit(0.0)) * g.history
    return values.select("facet", "feature", value.alias("value"))


def recommend(items: DataFrame, freqs: Frequencies, weights: Weights | None = None, g: Multipliers | None = None, history: DataFrame | None = None, scales=(1.0, 1.0, 1.0), most: int = GATHERED) -> DataFrame:
    """items with an integer score, truncated toward zero (D6). History counts only if its multiplier is positive."""
    return _finish(items, worths(freqs, weights, g, history, scales), most)


def recommend_linear(items: DataFrame, freqs: Frequencies, weights: Weights | None = None, g: Multipliers | None = None, most: int = GATHERED) -> DataFrame:
    """The older form: linear in author and word frequency, half for titles and not for tags."""
    weights, g = weights or Weights(), g or Multipliers()
    tags = _worth(FACETS[0], freqs.tags, weights.tags, TAG_WEIGHT, g.tag)
    authors = _worth(FACETS[1], freqs.authors, weights.authors, AUTHOR_WEIGHT, g.author, "freq")
    words = _worth(FACETS[2], freqs.words, weights.words, WORD_WEIGHT, 0.5 * g.title, "freq")
    return _finish(items, tags.unionByName(authors).unionByName(words), most)


def effective_weights(preset: DataFrame, overrides: DataFrame, freq: DataFrame) -> DataFrame:
    """(feature, weight): presets of features that exist; overrides win."""
    known = preset.join(freq.select("feature"), "feature", "left_semi").select("feature", F.col("weight").alias("preset"))
    both = known.join(overrides.select("feature", F.col("weight").alias("own")), "feature", "full")
    return both.select("feature", F.coalesce("own", "preset").alias("weight"))
