"""MinHash near-duplicate detection with tensored banding.

Two small collections of TABLES band keys each are formed, a key from ROWS minhashes. Table keys are the pairs of one key from either
collection, so TABLES * TABLES tables cost 2 * TABLES * ROWS minhashes and not TABLES * TABLES * 2 * ROWS. Two sets of similarity s meet in some table unless one of the
collections fails as a whole: at s = 0.8 with three rows and 14 keys a miss has a chance of 2 * (1 - 0.8^3)^14, below 1 in 10,000.

Documents with equal sets are one class, found by a digest of the set. A pair can only meet if it shares a key of either collection, so
keys that one class alone holds go before pairs of keys are formed. Candidates are confirmed on full sets, in rounds that lose no link and do not list
all pairs of a large group: first each class against the class that leads most of its tables; then, again and again, against a few leaders of other components; last,
of the pairs in a table, only those that the rounds before have left in different components and whose sizes, shared shingles by hash bucket and minhash bits allow the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import connected_components, release, slices, words, written

TABLES, ROWS = 14, 3
#: Distinct words whose hashes a task remembers at most.
MEMORY = 100_000
#: Minhash bits that may differ: the similarity asked for leaves 24 or fewer of 84 but for one pair in a million.
BITS_OFF = 24
#: Leaders that a class is held against in each round after the first, at most; rounds go on while they find links, and a last one tests all that is left.
LEADS = 4
#: Rounds against leaders at most; the last round tests whatever they have left apart.
TURNS = 12
#: Hash buckets of the counts that bound an intersection, a power of two; four counts of 16 bits are packed into a word.
PROFILE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_DRAW = np.random.Generator(np.random.PCG64(20240607))
_A = (_DRAW.integers(0, 1 << 63, 2 * TABLES * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _DRAW.integers(0, 1 << 63, 2 * TABLES * ROWS, dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; of a shorter text, that of its whole word sequence; none without words."""
    own = words(text)
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * _MIX + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def signature(found: np.ndarray, block: int = 4096) -> tuple[np.ndarray, int, int]:
    """Band keys of both collections and two words of minhash bits."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), block):
        np.minimum(least, (found[at : at + block, None] * _A + _B).min(0), out=least)
    bands = np.zeros(2 * TABLES, np.uint64)
    for k in range(ROWS):
        bands = _mix(bands * _MIX + least[k::ROWS])
    bits = (_mix(least) & np.uint64(1)).astype(np.int64)
    half = len(bits) // 2
    one, two = (int((b << np.arange(len(b))).sum()) for b in (bits[:half], bits[half:]))
    return (bands >> np.uint64(32)).astype(np.uint32).view(np.int32), one, two


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int32())), ("one", pa.int64()), ("two", pa.int64())])


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, one, two) of every row of docs (doc_id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = shingle_set(text or b"", width, hashes)
                if len(found):
                    rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), *signature(found)))
                else:
                    rows.append((0, None, None, None, None))
            columns = [pa.array([r[k] for r in rows], _SETS.field(k + 1).type) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], schema=_SETS)

    return docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, n_shingles long, set_key binary, bands array<int>, one long, two long")


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of doc_ids whose full sets, from texts (doc_id, text), are similar enough."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, last_set = _Hashes(), None, None
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column("text_a").cast(pa.binary()).to_pylist(), batch.column("text_b").cast(pa.binary()).to_pylist(), strict=True):
                if last is None or y != last:
                    last, last_set = y, shingle_set(y or b"", width, hashes)
                mine = shingle_set(x or b"", width, hashes)
                common = len(np.intersect1d(mine, last_set, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(mine) + len(last_set) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long").distinct()


def _profiles(reps: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(rep, shared, p0, p1, ..): of each of reps, how many shingles another of them also has, in all and in each of PROFILE hash buckets, packed.

    The sum of the lesser counts of two documents is at least the size of their intersection. A doc_id that stands for several texts gets no bound.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches):
            found = [shingle_set(t or b"", width, hashes) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            totals = [np.bincount((f & np.uint64(PROFILE - 1)).astype(np.int64), minlength=PROFILE).astype(np.int32) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(totals, pa.list_(pa.int32())), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["rep", "totals", "shingles"])

    held = texts.select(F.col("doc_id").alias("rep"), "text").join(reps, "rep", "left_semi")
    counted = written(held.mapInArrow(sets, "rep long, totals array<int>, shingles array<long>"), "near-profiles")
    alone = counted.select("rep", F.explode("shingles").alias("x")).groupBy("x").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1")
    own = alone.groupBy("rep", F.col("x").bitwiseAND(F.lit(PROFILE - 1)).cast("int").alias("k")).agg(F.count("*").cast("int").alias("n"))
    own = own.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("own"))
    one = counted.groupBy("rep").agg(F.first("totals").alias("totals"), F.count("*").alias("n")).join(own, "rep", "left")
    shared = F.transform("totals", lambda t, k: t - F.coalesce(F.col("own")[k], F.lit(0)))
    profile = one.select("rep", F.when(F.col("n") == 1, shared).otherwise(F.array_repeat(F.lit(65535), PROFILE)).alias("c"))

    def packed(k: int) -> Column:
        parts = [F.shiftleft(F.least(F.col("c")[k + m], F.lit(65535)).cast("long"), 16 * m) for m in range(4)]
        return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])

    profile = profile.select("rep", F.aggregate("c", F.lit(0).cast("long"), lambda x, y: x + y).alias("shared"), *[packed(4 * k).alias(f"p{k}") for k in range(PROFILE // 4)])
    made = written(profile, "near-profiles")
    release(counted)
    return made


def _most_common() -> Column:
    """Sum of the lesser counts of the profiles of sides a and b."""
    total = F.lit(0).cast("long")
    for k in range(PROFILE // 4):
        for m in range(4):
            x, y = (F.shiftrightunsigned(f"p{k}_{side}", 16 * m).bitwiseAND(F.lit(65535).cast("long")) for side in ("a", "b"))
            total = total + F.least(x, y)
    return total


_HELD = ["rep", "component", "main", "size", *[f"p{k}" for k in range(PROFILE // 4)], "one", "two", "bands"]


def _sides(apart: DataFrame, side: str) -> DataFrame:
    return apart.select("key", "i", "j", *[F.col(c).alias(f"{c}_{side}") for c in _HELD])


def _with_component(apart: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of tables that hold several components, each with its own, the one that has most rows of the table (main) and the table's number of rows (met)."""
    held = apart.join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counts = held.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("components"), F.sum("n").alias("met"))
    return held.join(counts.where("components > 1").select("key", F.col("most.component").alias("main"), "met"), "key")


def _could(percent: int) -> Column:
    """Whether sizes, shared shingles and minhash bits of sides a and b allow the similarity."""
    common = _most_common()
    fits = (common * 100 >= (F.col("size_a") + F.col("size_b") - common) * percent) | (F.least("size_a", "size_b") > 65535)
    bits = F.bit_count(F.col("one_a").bitwiseXOR(F.col("one_b"))) + F.bit_count(F.col("two_a").bitwiseXOR(F.col("two_b")))
    return (F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent) & (bits <= BITS_OFF) & fits


def _led_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with at most LEADS leaders of its tables that are in another component and could be near.

    The leader of a component in a table is its class that meets most others over all tables; each class meets the leaders of the first and the last component of a table.
    """
    held = apart.join(apart.groupBy("rep").agg(F.sum("met").alias("often")), "rep")
    best = held.groupBy("key", "component").agg(F.max(F.struct("often", *_HELD)).alias("best"), F.max("often").alias("often"))
    order = F.struct("often", "component")
    ends = best.groupBy("key").agg(F.max(F.struct(order.alias("o"), "best")).alias("top"), F.min(F.struct(order.alias("o"), "best")).alias("end"))
    leads = ends.select("key", F.explode(F.array("top.best", "end.best")).alias("lead")).select("key", *[F.col("lead")[c].alias(f"{c}_b") for c in _HELD])
    both = _sides(apart, "a").join(leads, "key").where((F.col("component_a") != F.col("component_b")) & _could(percent))
    count = both.groupBy(F.col("rep_a"), F.col("rep_b")).agg(F.count("*").alias("n"))
    few = count.groupBy("rep_a").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", F.col("rep_b").alias("lead"))), False), 1, LEADS).alias("leads"))
    pairs = few.select("rep_a", F.explode("leads.lead").alias("lead"))
    return pairs.select(F.greatest("rep_a", "lead").alias("a"), F.least("rep_a", "lead").alias("b")).distinct()


def same_id(some: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): for each doc_id of some (doc_id, set_key) that has several texts, each of their classes (set_key, rep) and the least of them."""
    digest = F.xxhash64("set_key")
    several = some.groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where("low < high").select("doc_id")
    held = some.join(several, "doc_id", "left_semi").join(classes.select("set_key", "rep"), "set_key").select("doc_id", "rep").distinct()
    least = held.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return held.join(least, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their shingle sets (words lower-cased in A-Z). A null text, or one without words,
    has no shingles and no link. Rows of equal doc_id are one document: whatever is linked with one of their texts is linked with all of them; a row
    without doc_id has none, a null component and is kept. Other columns are ignored; an empty table gives no rows.
    """
    sets = written(document_sets(docs, width), "near-sets")
    some = sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("size"), F.first("bands").alias("bands"), F.min("one").alias("one"), F.min("two").alias("two")), "near-classes")

    # keys that more than one class holds, by class
    keys = classes.select("rep", F.posexplode("bands").alias("k", "band"))
    shared = keys.groupBy("k", "band").agg(F.count("*").alias("n")).where("n > 1").select("k", "band")
    held = keys.join(shared, ["k", "band"]).groupBy("rep").agg(
        F.collect_list(F.when(F.col("k") < TABLES, F.struct("k", "band"))).alias("us"), F.collect_list(F.when(F.col("k") >= TABLES, F.struct("k", "band"))).alias("vs")
    )
    def place(u: Column, v: Column) -> Column:
        return F.struct(F.xxhash64(u["k"], u["band"], v["k"], v["band"]).alias("key"), u["k"].cast("short").alias("i"), v["k"].cast("short").alias("j"))

    places = held.select("rep", F.explode(F.flatten(F.transform("us", lambda u: F.transform("vs", lambda v: place(u, v))))).alias("p"))
    places = written(places.select("rep", "p.*"), "near-tables")

    # texts of all that can be candidates, once
    wanted = places.select(F.col("rep").alias("doc_id")).distinct()
    texts = written(docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), "near-texts")

    # first round: each class against the leader of most of its tables
    leaders = places.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    led = places.join(leaders, "key").where("rep <> lead").groupBy("rep", "lead").agg(F.count("*").alias("n"))
    first = written(led.groupBy("rep").agg(F.max(F.struct("n", "lead")).alias("m")).select(F.col("rep").alias("a"), F.col("m.lead").alias("b")), "near-pairs")
    links = _confirm(first, texts, width, percent).unionByName(same_id(some.select("doc_id", "set_key"), classes))
    links = written(links, "near-links")
    components = connected_components(links)

    # second round: pairs of a table that are still apart
    apart = places.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("key", "i", "j", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = apart.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    whole = written(apart.join(mixed, "key", "left_semi").join(classes.select("rep", "size", "one", "two", "bands"), "rep"), "near-apart")
    release(places)
    profiles = _profiles(whole.select("rep").distinct(), texts, width)
    apart = whole.join(profiles, "rep")
    # one with too many shingles of its own is near none of the others
    apart = apart.where((F.col("shared") * 100 >= F.col("size") * percent) | (F.col("size") > 65535)).drop("component")
    left = written(_with_component(apart, components), "near-apart")
    release(whole)
    release(profiles)
    tested, spent = first, [first, links, texts, classes]
    for _ in range(TURNS):
        # further rounds against leaders, as long as they link anything: a large group comes together without its pairs being listed
        led = written(_led_pairs(left, percent).join(tested, ["a", "b"], "left_anti"), "near-pairs")
        more = written(_confirm(led, texts, width, percent), "near-links")
        tested = tested.unionByName(led)
        spent += [led, more]
        if more.isEmpty():
            break
        links = links.unionByName(more)
        components = connected_components(links)
        # components only grow together, so a table that is within one goes for good
        old, left = left, written(_with_component(left.drop("component", "main", "met"), components), "near-apart")
        release(old)
    # last round: the pairs of a table that are still apart; a pair shows up once, in the table of the first keys of either collection that it shares
    # the main component of a table meets the others only, never itself
    a, b = _sides(left, "a"), _sides(left.where("component <> main"), "b")
    order = (F.col("component_a") == F.col("main_a")) | (F.col("component_a") < F.col("component_b"))
    alike = F.zip_with("bands_a", "bands_b", lambda x, y: x == y)
    once = (F.array_position(F.slice(alike, 1, TABLES), True) == F.col("i") + 1) & (F.array_position(F.slice(alike, TABLES + 1, TABLES), True) == F.col("j") - TABLES + 1)
    last = a.join(b, ["key", "i", "j"]).where((F.col("component_a") != F.col("component_b")) & order & _could(percent) & once).select(F.greatest("rep_a", "rep_b").alias("a"), F.least("rep_a", "rep_b").alias("b")).distinct()
    last = written(last.join(tested, ["a", "b"], "left_anti"), "near-pairs")
    spent += [left, last]
    if not last.isEmpty():
        more = written(_confirm(last, texts, width, percent), "near-links")
        spent.append(more)
        if not more.isEmpty():
            components = connected_components(links.unionByName(more))

    named = written(classes.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id")), "near-components")
    for table in spent:  # what is returned reads sets and named only
        release(table)
    by_row = sets.select("doc_id", "n_shingles", "set_key").join(named.hint("merge"), "set_key", "left")  # as many rows as there are classes: not to go through the driver
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return by_row.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
