"""Quality selection by importance resampling.

Two generative models over hashed word n-grams (one and two words), one of target text and one of all text, give each document an
importance weight, the ratio of its probabilities under them. Documents are drawn without replacement in proportion to their weights by
Gumbel top-k: log weight plus Gumbel noise, the k largest stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices, words, written

BUCKETS = 10_000
#: Distinct words whose hashes a task remembers at most.
MEMORY = 400_000
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of each word, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def buckets(text: bytes, hashes: _Hashes, size: int) -> np.ndarray:
    """Buckets of all words and all pairs of neighbouring words of a text."""
    own = words(text)
    h = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
    pairs = (h[:-1] * _PAIR) ^ h[1:]
    pairs = (pairs ^ (pairs >> np.uint64(29))) * _PAIR
    return (np.concatenate([h, pairs]) >> np.uint64(16)) % np.uint64(size)


def fit(docs: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """Log ratio of each bucket's probability in target text and in all text, from docs (text, target boolean); every bucket counts once more in both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = _Hashes(), np.zeros((2, size), np.int64)
        for batch in slices(batches):
            target = batch.column("target").to_pylist()
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                n = np.bincount(buckets(text or b"", hashes, size).astype(np.int64), minlength=size)
                total[0] += n
                if target[i]:
                    total[1] += n
        at = np.arange(size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0]), pa.array(total[1])], names=["bucket", "every", "target"])

    found = docs.select("text", "target").mapInArrow(count, "bucket int, every long, target long").groupBy("bucket").agg(F.sum("every"), F.sum("target")).collect()
    total = np.ones((2, size))
    for bucket, every, target in found:
        total[:, bucket] += (every, target)
    share = total / total.sum(1, keepdims=True)
    return np.log(share[1]) - np.log(share[0])


def weigh(docs: DataFrame, log_ratio: np.ndarray, seed: int = 17) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key) of every row of docs (doc_id, text); a null text counts as empty, of weight 1."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ratio = _Hashes(), shared.value
        for batch in slices(batches):
            n, weight, key = [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = buckets(text or b"", hashes, len(ratio))
                w = float(ratio[own.astype(np.int64)].sum())
                u = (xxhash.xxh3_64_intdigest(f"{i}\n".encode() + (text or b""), seed) + 0.5) / 2.0**64
                n.append(len(own))
                weight.append(w)
                key.append(w - math.log(-math.log(min(u, 1 - 2.0**-53))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(weight, pa.float64()), pa.array(key, pa.float64())], names=["doc_id", "n_grams", "log_weight", "gumbel_key"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, n_grams long, log_weight double, gumbel_key double")


def nth_largest(scores: DataFrame, column: str, k: int, bins: int = 2048, few: int = 4096) -> float:
    """The k-th largest value, exactly, by histograms over ever narrower ranges; at most `few` values are sorted at the end."""
    part = scores.select(F.col(column).alias("x"))
    while True:
        low, high, n = part.agg(F.min("x"), F.max("x"), F.count("*")).first()
        if low == high:
            return low
        if n <= few:
            return part.orderBy(F.col("x").desc()).limit(k).agg(F.min("x")).first()[0]
        width = (high - low) / bins
        if width <= 0 or low + width <= low:
            width = max(abs(high), abs(low)) * 2.0**-51
        at = F.least(F.floor((F.col("x") - low) / width), F.lit(bins)).cast("int")
        above = 0
        for b, m in sorted(((r[0], r[1]) for r in part.groupBy(at.alias("b")).agg(F.count("*")).collect()), reverse=True):
            if above + m >= k:
                part, k = part.where(at == b), k - above
                break
            above += m


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, size: int = BUCKETS, seed: int = 17) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, kept) for every row of docs (doc_id, text).

    Target text is that of documents with quality 1 in labels (doc_id, quality; the highest of repeated labels counts, null is none).
    share of all rows is drawn; None takes the share of quality 1 among labelled documents (all rows where none is labelled). Equal rows have equal
    keys and are kept or dropped together, so ties at the border may add rows. Null ids match no label; an empty table gives no rows.
    """
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("target"))
    good = written(good, "quality-labels")
    n_labels, n_good = good.agg(F.count("*"), F.count_if("target")).first()
    pool = docs.select("doc_id", "text").join(good.where("target").hint("shuffle_hash"), "doc_id", "left")
    ratio = fit(pool.select("text", F.coalesce("target", F.lit(False)).alias("target")), size)
    scores = written(weigh(docs, ratio, seed), "quality-scores")
    rows = scores.count()
    k = min(rows, math.ceil(rows * (share if share is not None else n_good / n_labels if n_labels else 1.0)))
    edge = nth_largest(scores, "gumbel_key", k) if k else math.inf
    return scores.withColumn("kept", F.col("gumbel_key") >= F.lit(edge))
