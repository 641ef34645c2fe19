"""Removal of repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

A passage counts as repeated where a window of WINDOW words also starts in a document of smaller doc_id. A greedy parse against a reference that holds such a window
cuts it at most once, so it leaves a factor of at least PROBE = WINDOW / 2 words of it. References are therefore indexed by spans of PROBE words, and not by
all of them: of the spans in a window the one of least hash (the first of equal ones) is its anchor, the same wherever the window stands. An anchor that only one document holds
needs no parse at all. Around every other anchor the words that its windows can reach make a stretch.

The stretches of an anchor, in all documents, are parsed in rounds. A round's reference blocks are the stretches of smallest doc_id of every anchor, indexed by it. Every other stretch is
factored against the block of its anchor: the factor grows greedily from the anchor to both sides as far as the words agree. Windows within the factor are repeated
from that document on. Windows that cross a boundary of the factor cannot be in this block; stretches that share one agree in the words up to and with the one at the boundary, so
those words join the key, and the next round's blocks are the first stretches under the longer keys. A stretch meets one reference a round, never the others of its group, and each round
removes every group's first stretch and lengthens the keys of the rest: no link is lost, no pairs are listed, and there are at most 2 * PROBE + 1 rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import release, slices, written

WINDOW = 50
PROBE = WINDOW // 2
#: Distinct words whose hashes a task remembers at most; stretches that it holds back to send equal ones once.
MEMORY, HELD = 200_000, 8_192
#: Stands for doc_id null, which comes after all others.
LAST = 2**63 - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: An odd number is invertible modulo 2^64, so spans are differences of prefix sums.
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, as many as the longest text so far needs."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.back, m, 1 << 64))])


_POWERS = [_Powers(b) for b in _BASES]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def words(text: bytes) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, unchanged."""
    return text.split()


def span_hashes(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of all spans of so many word hashes, by start."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    p = _POWERS[which]
    p.grow(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p.up[: len(h)], out=sums[1:])
    return _mix((sums[width:] - sums[:-width]) * p.down[: len(h) - width + 1])


def anchors(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each anchor, first and last start of the windows that have it) from the hashes of all PROBE-word spans of a text."""
    reach = WINDOW - PROBE + 1
    if len(spans) < reach:
        none = np.zeros(0, np.int64)
        return none, none, none
    least = np.lib.stride_tricks.sliding_window_view(spans, reach).argmin(1) + np.arange(len(spans) - reach + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first], first, np.concatenate([first[1:], [len(least)]]) - 1


def _word_hashes(text: bytes, hashes: dict) -> np.ndarray:
    own = words(text)
    return np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with what tells texts and documents apart: digest, and id, which is doc_id or the last one."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.unhex(F.md5(text)).alias("digest"))


def document_anchors(keyed: DataFrame) -> DataFrame:
    """(digest, id, anchors): distinct anchor hashes of every row that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches):
            found, keep = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                h = _word_hashes(text, hashes)
                keep.append(len(h) >= WINDOW)
                if keep[-1]:
                    spans = span_hashes(h, PROBE)
                    found.append(np.unique(spans[anchors(spans)[0]]).view(np.int64))
            held = batch.select(["digest", "id"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(found, pa.list_(pa.int64()))], names=["digest", "id", "anchors"])

    return keyed.select("digest", "id", "text").mapInArrow(run, "digest binary, id long, anchors array<long>")


_STRETCH = "digest binary, id long, places array<int>, keys array<long>, key long, check long, low int, high int, words binary"


def stretches(held: DataFrame) -> DataFrame:
    """Rows of two kinds from held (digest, id, text, anchors): a text's anchors by place with the keys of their stretches; and stretches.

    A stretch (key, check, low, high, words, id) stands for the windows that start low to high words before its anchor. words are the hashes of the PROBE words before the
    anchor, nearest first, and after it; those that no such window reaches are 0. key and check are two hashes of the anchor. Equal stretches have one key (keys[0]) and are sent once, with the
    smallest id, as far as a task meets them together.
    """
    schema = pa.schema([("digest", pa.binary()), ("id", pa.int64()), ("places", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())), ("key", pa.int64()), ("check", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, back = _Hashes(), {}
        for batch in slices(batches, 100):
            rows = []
            for digest, id_, text, wanted in zip(batch["digest"].to_pylist(), batch["id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["anchors"], strict=True):
                h = _word_hashes(text, hashes)
                spans = span_hashes(h, PROBE)
                at, first, last = anchors(spans)
                keep = np.isin(spans[at], wanted.values.to_numpy().view(np.uint64))
                at, low, high = at[keep], (at - last)[keep], (at - first)[keep]
                check = span_hashes(h, PROBE, 1)[at]
                ahead, beyond = at[:, None] - 1 - np.arange(PROBE), at[:, None] + PROBE + np.arange(PROBE)
                before = np.where(np.arange(PROBE) < high[:, None], h[np.maximum(ahead, 0)], 0)
                after = np.where(np.arange(PROBE) < PROBE - low[:, None], h[np.minimum(beyond, len(h) - 1)], 0)
                both = np.concatenate([before, after], axis=1).astype(np.uint64)
                own = np.concatenate([spans[at][:, None], check[:, None], low[:, None].astype(np.uint64), high[:, None].astype(np.uint64), both], axis=1)
                names = [xxhash.xxh3_64_intdigest(row.tobytes()) for row in own]
                keys = np.array(names, np.uint64).view(np.int64)
                rows.append((digest, id_, at.astype(np.int32), keys, None, None, None, None, None))
                anchor, check = spans[at].view(np.int64), check.view(np.int64)
                for k, name in enumerate(keys.tolist()):
                    known = back.get(name)
                    if known is None:
                        back[name] = [id_, (int(anchor[k]), int(check[k]), int(low[k]), int(high[k]), both[k].tobytes())]
                    elif id_ < known[0]:
                        known[0] = id_
            if len(back) >= HELD:
                rows += sent(back)
                back = {}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)
        rows = sent(back)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def sent(back: dict) -> list[tuple]:
        return [(None, id_, None, [name], *stretch) for name, (id_, stretch) in back.items()]

    return held.select("digest", "id", "text", "anchors").mapInArrow(run, _STRETCH)


_FACTORED = "stretch long, id long, key long, check long, low int, high int, words binary, found long"


def factor(met: DataFrame) -> DataFrame:
    """Stretches that met their group's first one (first_stretch, first_id, first_words), factored against it.

    Rows with found: windows low to high of a stretch start in document found. Rows without: windows that cross the factor's boundaries, under their longer keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            n = batch.num_rows
            if not n:
                continue
            own, other = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(n, 2 * PROBE) for c in ("words", "first_words"))
            low, high = (batch[c].to_numpy().astype(np.int64) for c in ("low", "high"))
            key, check, stretch, id_, first_id = (batch[c].to_numpy() for c in ("key", "check", "stretch", "id", "first_id"))
            alike = np.concatenate([own == other, np.zeros((n, 1), bool)], axis=1)
            left = np.minimum(np.where(alike[:, :PROBE].all(1), PROBE, alike[:, :PROBE].argmin(1)), high)
            right = np.minimum(np.where(alike[:, PROBE:-1].all(1), PROBE, alike[:, PROBE:-1].argmin(1)), PROBE - low)
            parts = [(np.maximum(low, PROBE - right), left, key, first_id, False)]
            sides = ((0, own[:, :PROBE], left, np.maximum(low, left + 1), high), (1, own[:, PROBE:], right, low, np.minimum(left, PROBE - right - 1)))
            for side, beyond, size, frm, to in sides:
                longer = key.view(np.uint64) + np.uint64(1 + side)
                for k in range(PROBE):
                    longer = np.where(k <= size, _mix(longer * _MIX + beyond[:, k]), longer)
                parts.append((frm, to, _mix(longer + size.astype(np.uint64)).view(np.int64), first_id, True))
            for frm, to, keys, found, open_ in parts:
                keep = np.flatnonzero(frm <= to)
                held = batch["words"].take(pa.array(keep)) if open_ else pa.nulls(len(keep), pa.binary())
                columns = [stretch[keep], id_[keep], keys[keep], check[keep], frm[keep].astype(np.int32), to[keep].astype(np.int32), held]
                columns = [*columns, pa.nulls(len(keep), pa.int64()) if open_ else pa.array(found[keep], pa.int64())]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in _FACTORED.split(", ")])

    return met.mapInArrow(run, _FACTORED)


def first_documents(found: DataFrame) -> DataFrame:
    """(stretch, low, high, found): for all windows of all stretches (stretch, id, key, check, low, high, words) the smallest id of a stretch that has them."""
    answers, todo = None, found
    for _ in range(2 * PROBE + 2):
        # written, so that the join deals both sides by itself and Spark can split a group of very many stretches
        first = written(todo.groupBy("key", "check").agg(F.min(F.struct("id", "stretch", "words")).alias("f")), "factors-blocks")
        met = todo.join(first, ["key", "check"]).select("*", F.col("f.id").alias("first_id"), F.col("f.stretch").alias("first_stretch"), F.col("f.words").alias("first_words")).drop("f")
        own = met.where("stretch = first_stretch").select("stretch", "id", "key", "check", "low", "high", F.lit(None).cast("binary").alias("words"), F.col("id").alias("found"))
        done = written(factor(met.where("stretch <> first_stretch")).unionByName(own), "factors-round")
        some = done.where("found IS NOT NULL").select("stretch", "low", "high", "found")
        answers = some if answers is None else answers.unionByName(some)
        todo = done.where("found IS NULL").drop("found")
        if todo.isEmpty():
            return answers
    raise RuntimeError("parsing did not end")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(digest, first, spans): of each text of docs (doc_id, text), by its digest: the smallest id that has it, and the word spans (start, end) that windows of documents of smaller id cover there."""
    keyed = _keyed(docs)
    found = written(document_anchors(keyed), "factors-anchors")
    one = found.groupBy("digest").agg(F.min("id").alias("first"), F.first("anchors").alias("anchors"))
    one = written(one, "factors-texts")
    places = one.select("digest", "first", F.explode("anchors").alias("anchor"))
    shared = places.groupBy("anchor").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").select("anchor")
    wanted = places.join(shared, "anchor").groupBy("digest").agg(F.min("first").alias("id"), F.collect_list("anchor").alias("anchors"))
    held = keyed.select("digest", "id", "text").join(wanted, ["digest", "id"])
    both = written(stretches(held), "factors-stretches")
    distinct = both.where("key IS NOT NULL").select(F.col("keys")[0].alias("stretch"), "id", "key", "check", "low", "high", "words")
    distinct = distinct.groupBy("stretch").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("key", "check", "low", "high", "words")])
    answers = first_documents(written(distinct, "factors-distinct"))
    at = both.where("key IS NULL").select("digest", "id", F.explode(F.arrays_zip("places", "keys")).alias("p")).select("digest", "id", F.col("p.places").alias("place"), F.col("p.keys").alias("stretch")).distinct()
    spans = at.join(answers, "stretch").where("found < id").select("digest", F.struct((F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + WINDOW).alias("end")).alias("span"))
    spans = spans.groupBy("digest").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    release(found)
    return one.select("digest", "first").join(spans, "digest", "left")


_OUT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed) for every row of docs (doc_id, text): what is left once each word goes that a window of WINDOW words covers which also starts in a document of smaller doc_id.

    kept is the words left, joined by a blank; removed lists the word spans that went. Windows are judged on the texts as they came. Words differ by case; a null or empty text has
    none. A document of fewer than WINDOW words keeps all, and so does the first of equal documents; rows of equal doc_id remove nothing of each other; a row without doc_id comes after all that
    have one. Repeats within a document stay. Other columns are ignored; an empty table gives no rows.
    """
    found = written(repeated_spans(docs), "factors-spans")
    held = _keyed(docs).join(found, "digest", "left").select("doc_id", "text", (F.col("id") > F.col("first")).alias("copy"), "spans")
    removed = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, copy, spans in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["copy"].to_pylist(), batch["spans"], strict=True):
                own = words(text)
                merged = [[0, len(own)]] if copy and len(own) >= WINDOW else []
                if not merged and spans.is_valid:
                    for start, end in zip(*(spans.values.field(c).to_pylist() for c in ("start", "end")), strict=True):
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([start, end])
                kept, at = [], 0
                for start, end in merged:
                    kept += own[at:start]
                    at = end
                kept += own[at:]
                rows.append((len(own), len(own) - len(kept), b" ".join(kept).decode(), [{"start": s, "end": e} for s, e in merged]))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), removed))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *columns], names=["doc_id", "n_words", "n_removed", "kept", "removed"])

    return held.mapInArrow(run, _OUT)

