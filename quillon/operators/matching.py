"""Matching item names to folders, exactly and by likeness."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.schema import NO_FOLDER
from quillon.sources.scratch import stored

#: How much rarer each further occurrence of a character in a name is taken to be; any value gives the same matches.
RARER = 0.35
#: Likenesses that match_close asks for before its cutoff: a name that has a folder at one of them needs no pairs below it.
STEPS = (0.9, 0.75)
#: An element whose pairs are more than one part in so many of all is spread over salts.
HOT = 100
#: Classes of lengths to a doubling of length.
CLASSES = 4


def unique_folders(folders: DataFrame) -> DataFrame:
    """One path a folder name: that of the last row in order of pos."""
    return folders.groupBy("folder_name").agg(F.max_by("path", "pos").alias("path"))


def match_exact(items: DataFrame, folders: DataFrame) -> DataFrame:
    """items with local_path where the sanitised file name is a folder's name, else null (J1). folders: (folder_name, path, pos)."""
    named = items.withColumn("_name", T.sanitise_name(F.col("file_name")))
    found = unique_folders(folders).where("folder_name <> ''").select(F.col("folder_name").alias("_name"), F.col("path").alias("local_path"))
    return named.join(found.hint("merge"), "_name", "left").select(*items.columns, "local_path")


def character_ranks(names: DataFrame) -> dict[str, int]:
    """How many of names (name) have each character; at most as many entries as there are characters."""
    return {r[0]: r[1] for r in names.select(F.explode(F.array_distinct(F.split("name", ""))).alias("c")).where("c <> ''").groupBy("c").count().collect()}


def pair_ranks(names: DataFrame, folders: DataFrame) -> dict[str, int]:
    """For each character that both names and folders (name) have, how many pairs of them share it."""
    left, right = character_ranks(names), character_ranks(folders)
    return {c: n * right[c] for c, n in left.items() if c in right}


def with_elements(names: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """names (name, ..) with the elements of its multiset of characters: each character with the number of its occurrence, as one number, rarest first.

    Characters without a rank can be shared by no pair; they come first, as numbers below 0.
    """
    held = names.sparkSession.sparkContext.broadcast(ranks)

    def elements(texts: pa.Array) -> pa.Array:
        known, out = held.value, []
        for text in texts.to_pylist():
            seen, own = Counter(), []
            for c in text:
                seen[c] += 1
                element = ord(c) << 32 | seen[c]
                own.append((known[c] * RARER ** (seen[c] - 1), element) if c in known else (-1.0, ~element))
            out.append(np.array([e for _, e in sorted(own)], np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    return names.withColumn("elements", F.arrow_udf(elements, "array<long>")("name"))


def _length_class(length: Column) -> Column:
    return F.floor(F.log2(length.cast("double")) * CLASSES).cast("int")


def _placed(names: DataFrame, cutoff: float) -> DataFrame:
    """names with a row for each element that a folder may have: its place, and the least and the greatest length of a text that can reach the cutoff if this is the first element that it shares.

    From place i on at most n - i elements are shared, of both lengths' half times the cutoff that are needed: the further back an element stands, the shorter the other text has to be.
    """
    c, n = max(cutoff - 1e-9, 1e-6), F.size("elements")
    placed = names.select("*", n.alias("length"), F.posexplode("elements").alias("place", "element")).where("element >= 0")
    low = F.greatest(F.ceil(F.col("length") * (c / (2 - c)) - 1e-6).cast("int"), F.lit(1))
    high = F.least(F.floor((F.col("length") - F.col("place")) * (2 / c) - F.col("length") + 1e-6), F.lit(1 << 30)).cast("int")
    return placed.withColumn("low", low).withColumn("high", high).where("low <= high")


def candidates(names: DataFrame, folders: DataFrame, cutoff: float, salts: int = 8) -> DataFrame:
    """(name, folder, common, n, m): the pairs of names (name, elements) and folders (folder, elements) that share one of their rarest elements, each once, as far as lengths and places of that element allow the cutoff.

    Likeness is twice the matched characters over both lengths, and no more characters match than the multisets share (common). So a set-similarity join with prefix filter loses
    nothing: elements in one order for all names, the rarest first; only the beginnings of the lists, which every pair above the cutoff has to share, are joined. How long a beginning is
    goes by both lengths, so a name meets folders by element and class of length, with a shorter beginning for longer folders. An element with many of all pairs is spread over salts.
    """
    left = _placed(names, cutoff).select("name", "elements", "element", F.col("length").alias("n"), F.col("place").alias("i"), F.explode(F.sequence(_length_class(F.col("low")), _length_class(F.col("high")))).alias("class"))
    right = _placed(folders, cutoff).select("folder", F.col("elements").alias("others"), "element", F.col("length").alias("m"), F.col("place").alias("j"), _length_class(F.col("length")).alias("class"))
    key = ["element", "class"]
    counts = [side.groupBy(*key).agg(F.count("*").cast("double").alias(f"of_{k}")) for k, side in enumerate((left, right))]
    keys = stored(counts[0].join(counts[1].hint("merge"), key).select(*key, F.xxhash64(*key).alias("hash"), (F.col("of_0") * F.col("of_1")).alias("pairs")), "keys")
    pairs = keys.agg(F.sum("pairs")).first()[0]
    hot = [r[0] for r in keys.where(F.col("pairs") * HOT > (pairs or 0.0)).select("hash").collect()]  # fewer than HOT rows
    is_hot = F.xxhash64(*key).isin(hot) if hot else F.lit(False)
    # only what meets goes on
    left = left.join(keys, key, "left_semi").withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("name"), salts).cast("int")).otherwise(0))
    right = right.join(keys, key, "left_semi").withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    n, m = F.col("n"), F.col("m")
    fits = 2.0 * F.least(n - F.col("i"), m - F.col("j")) / (n + m) >= cutoff - 1e-9
    met = left.join(right.hint("merge"), [*key, "salt"]).where(fits)  # exploded, so Spark guesses them too small for a broadcast
    shared = F.array_intersect("elements", "others")
    return met.where(shared[0] == F.col("element")).select("name", "folder", F.size(shared).alias("common"), "n", "m")


def _subsequence(a: str, places: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence of a and a text of so many characters, whose places of each character are bits."""
    whole = (1 << size) - 1
    row = whole
    for c in a:
        here = row & places.get(c, 0)
        row = ((row + here) | (row - here)) & whole
    return size - row.bit_count()


def likeness(pairs: DataFrame, cutoff: float) -> DataFrame:
    """(name, folder, ratio) of the pairs whose Ratcliff-Obershelp ratio, as difflib counts it, reaches the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, last, places = difflib.SequenceMatcher(), None, {}
        for batch in batches:
            ratios = []
            for name, folder in zip(batch.column("name").to_pylist(), batch.column("folder").to_pylist(), strict=True):
                if name != last:
                    matcher.set_seq2(name)
                    last, places = name, {}
                    for k, c in enumerate(name):
                        places[c] = places.get(c, 0) | 1 << k
                # matched blocks follow each other in both texts, so they are a common subsequence
                if 2.0 * _subsequence(folder, places, len(name)) / (len(name) + len(folder)) < cutoff:
                    ratios.append(None)
                    continue
                matcher.set_seq1(folder)
                ratio = matcher.ratio()
                ratios.append(ratio if ratio >= cutoff else None)
            found = pa.array(ratios, pa.float64())
            out = pa.RecordBatch.from_arrays([batch.column("name"), batch.column("folder"), found], names=["name", "folder", "ratio"])
            yield out.filter(found.is_valid())

    return pairs.select("name", "folder").mapInArrow(run, "name string, folder string, ratio double")


def match_close(items: DataFrame, folders: DataFrame, cutoff: float = 0.6, salts: int = 8) -> DataFrame:
    """items with local_path: the exact match, else the folder of greatest likeness at or above the cutoff (of equal ones the greatest name), else the sentinel.

    Distinct names only. Pairs meet by rare shared characters (candidates); then the exact bound by shared characters, a bound by common subsequence, and last difflib itself.
    High likenesses are asked for first: whatever reaches one is found then, so the greatest of a name that has any is among them, and only the other names go on to lower ones.
    """
    exact = match_exact(items, folders)
    named = exact.withColumn("_name", T.sanitise_name(F.col("file_name")))
    rest = stored(named.where("local_path IS NULL AND _name <> ''").select(F.col("_name").alias("name")).distinct(), "names")
    known = stored(unique_folders(folders).where("folder_name <> ''"), "folders")
    ranks = pair_ranks(rest, known.select(F.col("folder_name").alias("name")))
    tasks = items.sparkSession.sparkContext.defaultParallelism  # the names of a file or two are dealt to all
    left = stored(with_elements(rest.repartition(tasks), ranks), "name-elements")
    right = stored(with_elements(known.select(F.col("folder_name").alias("name")).repartition(tasks), ranks).withColumnRenamed("name", "folder"), "folder-elements")
    best = None
    for step in [*(x for x in STEPS if x > cutoff), cutoff]:
        able = candidates(left, right, step, salts).where(2.0 * F.col("common") / (F.col("n") + F.col("m")) >= step)
        found = stored(likeness(able, step).groupBy("name").agg(F.max(F.struct("ratio", "folder"))["folder"].alias("folder_name")), "matches")
        best = found if best is None else best.unionByName(found)
        if step > cutoff:
            left = stored(left.join(found.hint("merge"), "name", "left_anti"), "name-elements")
            if left.isEmpty():
                break
    close = best.join(known.hint("merge"), "folder_name").select(F.col("name").alias("_name"), F.col("path").alias("_close"))
    out = named.join(close.hint("merge"), "_name", "left")
    return out.withColumn("local_path", F.coalesce("local_path", "_close", F.lit(NO_FOLDER))).select(*items.columns, "local_path")
