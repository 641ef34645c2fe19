"""Document fingerprints from prefix polynomial hashes.

For a text c[0..n) the prefix array S[i] = sum of c[j] * B^j for j < i, modulo the prime 2^31 - 1 and for two bases, gives the hash of any span
as (S[i+k] - S[i]) / B^i: equal spans have equal hashes wherever they stand, so span equality takes constant time and longest common
extensions a binary search. A joined text gets its prefix array from those of its parts. A fingerprint holds the hash of the whole text and
the least mixed hashes of its spans of WIDTH code points, whose overlap estimates the likeness of two texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices

PRIME = (1 << 31) - 1
BASES = (1_000_003, 805_306_457)
#: Code points of a span, and values in a sketch.
WIDTH, SKETCH = 16, 64
#: Documents in a bucket of neighbours, about, and buckets at most (larger buckets then; rows stream through them).
BUCKET, BUCKETS = 512, 16_384
_P, _S = np.uint64(PRIME), np.uint64(31)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mod(x: np.ndarray) -> np.ndarray:
    """x below 2^62, modulo the prime."""
    x = (x & _P) + (x >> _S)
    x = (x & _P) + (x >> _S)
    return np.where(x >= _P, x - _P, x)


class _Powers:
    """Powers of a base and of its inverse, as many as the longest text so far needs."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            by, back = pow(self.base, m, PRIME), pow(pow(self.base, -1, PRIME), m, PRIME)
            self.up = np.concatenate([self.up, _mod(self.up * np.uint64(by))])
            self.down = np.concatenate([self.down, _mod(self.down * np.uint64(back))])


_POWERS = [_Powers(b) for b in BASES]


class Prefixes:
    """The prefix arrays of a text."""

    def __init__(self, sums: list[np.ndarray]):
        self.sums = sums
        self.n = len(sums[0]) - 1
        for p in _POWERS:
            p.grow(self.n + 1)

    @classmethod
    def of(cls, text: str) -> Prefixes:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        sums = []
        for p in _POWERS:
            p.grow(len(codes) + 1)
            out = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(_mod(codes * p.up[: len(codes)]), out=out[1:])
            sums.append(_mod(out))
        return cls(sums)

    def join(self, length: int, other: Prefixes, other_length: int) -> Prefixes:
        """The prefix arrays of this text's first `length` code points followed by the other's first `other_length`."""
        sums = []
        for p, a, b in zip(_POWERS, self.sums, other.sums, strict=True):
            p.grow(length + other_length + 1)
            sums.append(np.concatenate([a[: length + 1], _mod(a[length] + _mod(b[1 : other_length + 1] * p.up[length]))]))
        return Prefixes(sums)

    def spans(self, width: int) -> np.ndarray:
        """Hashes of all spans of a width, by start."""
        m = self.n - width + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        one, two = (_mod(_mod(s[width:] + _P - s[:m]) * p.down[:m]) for p, s in zip(_POWERS, self.sums, strict=True))
        return (one << _S) | two

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hash of one span."""
        return tuple((int(s[end]) - int(s[start])) * int(p.down[start]) % PRIME for p, s in zip(_POWERS, self.sums, strict=True))


def same(a: Prefixes, i: int, b: Prefixes, j: int, width: int) -> bool:
    """Whether a[i:i+width] equals b[j:j+width]."""
    return i + width <= a.n and j + width <= b.n and a.span(i, i + width) == b.span(j, j + width)


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:]."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if same(a, i, b, j, mid) else (low, mid - 1)
    return low


def sketch(prefixes: Prefixes, width: int = WIDTH, size: int = SKETCH) -> np.ndarray:
    """The least distinct mixed hashes of the spans, in order; a text below the width is one span."""
    spans = prefixes.spans(min(width, prefixes.n)) if prefixes.n else np.zeros(0, np.uint64)
    z = spans * _MIX
    z = ((z ^ (z >> np.uint64(32))) * _MIX) >> np.uint64(32)
    if len(z) > 4 * size:
        least = np.unique(np.partition(z, 4 * size)[: 4 * size])
        if len(least) >= size:
            return least[:size]
    return np.unique(z)[:size]


def fingerprint(prefixes: Prefixes, least: np.ndarray) -> str:
    """Length and hash of the whole text, then the sketch, in hexadecimal."""
    one, two = prefixes.span(0, prefixes.n)
    return f"{prefixes.n:x}-{one:08x}{two:08x}-{least.astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Estimated share of spans that two texts have in common, from their fingerprints; 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition("-")[2]), ">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    size = SKETCH if max(len(x), len(y)) >= SKETCH else len(x) + len(y)
    union = np.unique(np.concatenate([x, y]))[:size]
    return float((np.isin(union, x) & np.isin(union, y)).sum()) / len(union)


def neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, lead, key, doc_id, text), dealt by bucket and sorted: in each bucket rows stand by descending key, then text, and the row that follows the bucket's last stands last, marked as lead.

    Buckets are ranges of key (doc_id; null below all others) between quantiles, a documented bound on their number. Only the range borders and each
    bucket's largest key go through the driver; texts are shuffled once, a bucket's first row twice.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"))
    ids = keyed.select("key")
    n = min(BUCKETS, ids.count() // BUCKET + 1)
    borders = np.unique(ids.approxQuantile("key", [i / n for i in range(1, n)], 1 / (4 * n))) if n > 1 else np.zeros(0)

    def place(key: pd.Series) -> pd.Series:
        return pd.Series(len(borders) - np.searchsorted(borders, key.to_numpy().astype(np.float64)), dtype="int32")

    bucket = F.pandas_udf(place, "int")("key")
    heads = sorted((r[0], r[1]) for r in ids.select("key", bucket.alias("bucket")).groupBy("bucket").agg(F.max("key")).collect())
    before = [(key, heads[i - 1][0]) for i, (_, key) in enumerate(heads)]
    leads = F.broadcast(docs.sparkSession.createDataFrame(before, "key long, lead_of int"))  # BUCKETS rows at most
    both = keyed.withColumn("bucket", bucket).join(leads, "key", "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("lead"))
    ahead = F.struct(F.col("lead_of").alias("bucket"), F.lit(True).alias("lead"))
    places = F.when(F.col("lead_of").isNull(), F.array(own)).otherwise(F.array(own, ahead))
    dealt = both.select(F.explode(places).alias("p"), "key", "doc_id", "text").select("p.bucket", "p.lead", "key", "doc_id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "lead", F.col("key").desc(), "text")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited long, same_next long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _OUT.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in _OUT.split(", ")]
    held = None
    for batch in slices(batches):
        rows = []
        for bucket, lead, doc_id, text in zip(*(batch.column(c) for c in ("bucket", "lead", "doc_id", "text")), strict=True):
            bucket, lead = bucket.as_py(), lead.as_py()
            if lead and (held is None or held[0] != bucket):
                continue  # a further row of the lead's key
            text = text.as_py()
            own = Prefixes.of(text)
            print_ = fingerprint(own, sketch(own))
            if held is not None and held[0] == bucket:
                _, last_id, last_text, last, last_print = held
                half = last.n // 2
                edited = last.join(last.n - half, own, min(half, own.n))
                edited_print = fingerprint(edited, sketch(edited))
                digest = hashlib.sha256((last_text[: last.n - half] + text[:half]).encode()).hexdigest()
                rows.append((last_id, last.n, digest, last_print, edited_print, likeness(last_print, edited_print), likeness(last_print, print_), common_extension(last, 0, edited, 0), common_extension(last, 0, own, 0)))
            held = None if lead else (bucket, doc_id.as_py(), text, own, print_)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text) against its edited text and the next row in descending order of doc_id (after the last: the first).

    The edited text has its last floor(n/2) code points replaced by the first as many of the next row's text, or all of it. Null texts count as
    empty; null ids come last; rows of equal id follow in order of text; a single row is its own next; an empty table gives no rows. same_edited and same_next
    are the lengths of the longest common beginnings with the edited and the next text.
    """
    return neighbours(docs).select("bucket", "lead", "doc_id", "text").mapInArrow(_compare, _OUT)
