"""Language-model scoring with Brown class-based n-grams.

A text's probability is the product over its tokens of P(class | class before) * P(token | class). Exchange clustering assigns classes: a unit
moves to the class that raises the likelihood of the class bigrams most, again and again. Units of a first exchange are the CORE most frequent words one
by one, the end of text, and all other words by hashed ending. From there the exchange goes on over all training text for each of the TOP most frequent words: in up to
ROUNDS sweeps their neighbours' classes are counted and each moves to the class of greatest gain, all words of a sweep at once; a sweep that does not raise the
likelihood is taken back. Every rarer training word then gets the class of greatest likelihood under these by its own neighbours. Only words that training
never met have the class of their ending.

Texts are read where they lie. Only counts are shuffled, and of the texts those words that are not among the TOP most frequent, to meet their counts and
classes, which grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import release, slices, written

#: Frequent words that are sent to every task with their counts: a fixed bound.
TOP = 262_144
#: Words that are units of their own, hashed endings, classes.
CORE, ENDINGS, CLASSES = 1536, 512, 64
END = CORE
UNITS = CORE + 1 + ENDINGS
#: Sweeps over all units at most.
SWEEPS = 12
#: Sweeps over the top words at most; words of a block of counts; tasks whose counts are added up first.
ROUNDS, BLOCK, NEAR_TASKS = 2, 256, 64
CELLS = BLOCK * 2 * CLASSES
#: Neighbours that a task holds before it counts them.
WAIT = 4_000_000
#: Texts that are cut into words at a time.
TEXTS = 1000


def endings(words: pa.Array) -> np.ndarray:
    """Units of words that are not in the core, by their last three bytes."""
    if not len(words):
        return np.zeros(0, np.int32)
    _, offsets, data = words.buffers()
    offsets, data = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1], np.frombuffer(data, np.uint8)
    code = np.zeros(len(words), np.uint32)
    for k in range(3):
        code = code * np.uint32(257) + np.where(np.diff(offsets) > k, data[np.maximum(offsets[1:] - 1 - k, 0)] + np.uint32(1), np.uint32(0))
    return CORE + 1 + ((code * np.uint32(2654435761)) >> np.uint32(8)).astype(np.int32) % ENDINGS


def ending(word: bytes) -> int:
    """Unit of one word."""
    return int(endings(pa.array([word], pa.binary()))[0])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, one text after the other, with A-Z lowered, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # gives blanks at either end of a text, so that no list is empty
    flat, first = lists.flatten(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), np.add.reduceat(some.to_numpy(zero_copy_only=False).astype(np.int64), first)


def in_order(rank: dict[bytes, int]) -> pa.Array:
    """Words by rank."""
    return pa.array(sorted(rank, key=rank.get), pa.binary()).cast(pa.string())


class _Texts:
    """Some texts as one run of word numbers, each text between two ends."""

    def __init__(self, texts: pa.Array, top: pa.Array):
        """top: words by number; other words have TOP plus the unit of their ending."""
        self.words, self.n = split_words(texts)
        self.first = np.cumsum(self.n + 2) - self.n - 2  # where each text begins
        self.place = np.arange(len(self.words)) + 2 * np.repeat(np.arange(len(self.n)), self.n) + 1  # where each word stands
        number = pc.index_in(self.words, value_set=top)
        other = number.is_null().to_numpy(zero_copy_only=False)
        number = np.array(number.fill_null(0))
        number[other] = TOP + endings(self.words.filter(pa.array(other)))
        self.u = np.full(len(self.words) + 2 * len(self.n), TOP + END, np.int32)
        self.u[self.place] = number
        self.known = (self.u < TOP) | (self.u == TOP + END)
        self.inner = np.ones(len(self.u) - 1, bool)  # the end of one text and the beginning of the next are no neighbours
        self.inner[self.first[1:] - 1] = False

    def rare(self) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array, pa.Array]:
        """Where rarer words stand, and which; where two of them are neighbours, and which."""
        at, two = np.flatnonzero(~self.known), np.flatnonzero(~(self.known[:-1] | self.known[1:]))
        names = [self.words.take(pa.array(np.searchsorted(self.place, x))) for x in (at, two, two + 1)]
        return at, names[0], two, names[1], names[2]

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of values, one a place, by text."""
        return np.add.reduceat(values, self.first)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of docs (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = split_words(batch.column("text"))[0].value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def top_words(vocabulary: DataFrame, most: int = TOP) -> list[tuple[bytes, int]]:
    """The words above a count, at most `most` of them, by count then word."""
    step = F.floor(F.log2("n") * 64).cast("int")
    found, above = None, 0
    for level, n in sorted(((r[0], r[1]) for r in vocabulary.groupBy(step.alias("s")).agg(F.count("*")).collect()), reverse=True):
        above += n
        if above > most:
            break
        found = level
    if found is None:
        return []
    rows = vocabulary.where(step >= found).collect()
    return sorted(((r["word"].encode(), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def unit_bigrams(docs: DataFrame, core: dict[bytes, int]) -> np.ndarray:
    """Counts of neighbouring units over all texts of docs (text), each text between two ends: UNITS * UNITS cells. core: unit of each core word."""
    shared = docs.sparkSession.sparkContext.broadcast(in_order(core))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = shared.value, np.zeros(UNITS * UNITS, np.int64)
        for batch in slices(batches, TEXTS):
            t = _Texts(batch.column("text"), index)
            u = np.where(t.u < TOP, t.u, t.u - TOP)
            at, n = np.unique((u[:-1] * np.int32(UNITS) + u[1:])[t.inner], return_counts=True)
            total[at] += n
        grid = total.reshape(UNITS, UNITS)
        left = np.flatnonzero(grid.any(1))
        right = [np.flatnonzero(grid[u]) for u in left]
        yield pa.RecordBatch.from_arrays(
            [pa.array(left.astype(np.int32)), pa.array([r.astype(np.uint16).tobytes() for r in right], pa.binary()), pa.array([grid[u, r].tobytes() for u, r in zip(left, right, strict=True)], pa.binary())],
            names=["unit", "after", "n"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, total = None, np.zeros(UNITS, np.int64)

        def row() -> pa.RecordBatch:
            after = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([after.astype(np.uint16).tobytes()], pa.binary()), pa.array([total[after].tobytes()], pa.binary())], names=["unit", "after", "n"])

        for batch in batches:
            for u, after, n in zip(batch.column("unit").to_pylist(), batch.column("after").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if u != unit:
                    if unit is not None:
                        yield row()
                    unit, total = u, np.zeros(UNITS, np.int64)
                total[np.frombuffer(after, np.uint16)] += np.frombuffer(n, np.int64)
        if unit is not None:
            yield row()

    schema = "unit int, after binary, n binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition("unit").sortWithinPartitions("unit").mapInArrow(add, schema)
    grid = np.zeros((UNITS, UNITS), np.int64)
    for u, after, n in summed.collect():  # UNITS rows at most
        grid[u, np.frombuffer(bytes(after), np.uint16)] = np.frombuffer(bytes(n), np.int64)
    return grid


def exchange(grid: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit. The end of text is alone in the last class; the others begin dealt out in order of frequency."""
    n = grid.astype(np.float64)
    often = n.sum(1) + n.sum(0)
    order = [u for u in np.argsort(-often, kind="stable") if u != END]
    of = np.full(len(n), classes - 1)
    of[order] = np.arange(len(order)) % (classes - 1)
    member = np.zeros((len(n), classes))
    member[np.arange(len(n)), of] = 1.0
    right, left = n @ member, n.T @ member  # classes after and before each unit
    joint = member.T @ right

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    free = np.arange(classes - 1)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not often[u]:
                break
            g, r, c, s = of[u], right[u].copy(), left[u].copy(), n[u, u]
            base = joint.copy()
            base[g] -= r
            base[:, g] -= c
            base[g, g] += s
            r[g] -= s
            c[g] -= s
            out, into, own = base.sum(1), base.sum(0), base.diagonal()
            gain = (f(base + r) - f(base)).sum(1) + (f(base + c[:, None]) - f(base)).sum(0)
            gain += f(own + r + c + s) - f(own + r) - f(own + c) + f(own)
            gain -= f(out + r.sum() + s) - f(out) + f(into + c.sum() + s) - f(into)
            h = int(free[np.argmax(gain[free])])
            if h != g and gain[h] > gain[g] + 1e-6:
                base[h] += r
                base[:, h] += c
                base[h, h] += s
                joint = base
                of[u] = h
                right[:, g] -= n[:, u]
                right[:, h] += n[:, u]
                left[:, g] -= n[u]
                left[:, h] += n[u]
                moved += 1
        if moved < len(order) / 500:
            break
    return of


class _Tally:
    """Class bigrams of a task, and the neighbours' classes of its top words outside the core: word * 2 * CLASSES + class after, or + CLASSES + class before."""

    def __init__(self):
        self.joint, self.codes, self.n, self.wait, self.waiting = np.zeros(CLASSES * CLASSES, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), [], 0

    def add(self, t: _Texts, c: np.ndarray) -> None:
        """Texts and the classes of their words."""
        pair = t.known[:-1] & t.known[1:] & t.inner
        self.joint += np.bincount(c[:-1][pair].astype(np.int32) * CLASSES + c[1:][pair], minlength=CLASSES**2)
        top = (t.u >= CORE) & (t.u < TOP)
        for word, code, own in ((t.u[:-1], c[1:], top[:-1]), (t.u[1:], c[:-1] + np.int16(CLASSES), top[1:])):
            own = own & t.inner
            self.wait.append(word[own] * np.int32(2 * CLASSES) + code[own])
            self.waiting += len(self.wait[-1])
        if self.waiting > WAIT:
            self.count()

    def count(self) -> None:
        codes, n = np.unique(np.concatenate([self.codes[:0], *self.wait]), return_counts=True)
        if len(self.codes):
            codes, place = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
            n = np.bincount(place, np.concatenate([self.n, n]), len(codes)).astype(np.int64)
        self.codes, self.n, self.wait, self.waiting = codes, n, [], 0

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, cell, count); block -1 holds the class bigrams."""
        self.count()
        at = np.flatnonzero(self.joint)
        yield -1, at, self.joint[at]
        block = self.codes // CELLS
        first = np.flatnonzero(np.diff(block, prepend=-1))
        for low, high in zip(first, [*first[1:], len(block)][: len(first)], strict=True):
            yield int(block[low]), self.codes[low:high] % CELLS, self.n[low:high]


_SUMS = "block int, part int, at binary, n binary"
_MET = f"{_SUMS}, word string, own int, before int, after int, other string, other_own int"


def neighbours(docs: DataFrame, shared, of: np.ndarray, rare: bool) -> DataFrame:
    """One reading of all texts under classes `of` by word number: rows of counts by block (a _Tally for each task) and, if asked for, of rarer words.

    Of these each occurrence is a row (word, class of its ending, class before, class after; CLASSES more where the neighbour is itself rare), and so is each pair of rare neighbours
    (word, other). shared: the top words by rank, broadcast.
    """
    names = [c.split()[0] for c in _MET.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
    classes = docs.sparkSession.sparkContext.broadcast(of.astype(np.int16))

    def batch_of(columns: dict, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c].cast(k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, tally, of, part = shared.value, _Tally(), classes.value, TaskContext.get().partitionId() // NEAR_TASKS
        for batch in slices(batches, TEXTS):
            t = _Texts(batch.column("text"), index)
            c = of[t.u]
            tally.add(t, c)
            if rare:
                at, names, two, left, right = t.rare()
                beside = c + np.where(t.known, 0, CLASSES).astype(np.int16)
                yield batch_of({"word": names, "own": pa.array(c[at]), "before": pa.array(beside[at - 1]), "after": pa.array(beside[at + 1])}, len(at))
                yield batch_of({"word": left, "own": pa.array(c[two]), "other": right, "other_own": pa.array(c[two + 1])}, len(two))
        for block, at, n in tally.rows():
            yield batch_of({"block": pa.array([block]), "part": pa.array([part]), "at": pa.array([at.astype(np.uint16).tobytes()]), "n": pa.array([n.tobytes()])}, 1)

    return docs.select("text").mapInArrow(meet, _MET)


def added(sums: DataFrame, *by: str) -> DataFrame:
    """The counts of sums added up by block, or by block and part: rows stream by in order, and one block is held at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(CELLS, np.int64)

        def row() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([total[at].tobytes()])], names=["block", "part", "at", "n"])

        for batch in batches:
            for block, part, at, n in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "at", "n")), strict=True):
                own = (block, part if len(by) > 1 else 0)
                if own != key:
                    if key is not None:
                        yield row()
                    key = own
                    total[:] = 0
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
        if key is not None:
            yield row()

    return sums.select("block", "part", "at", "n").repartition(*by).sortWithinPartitions(*by).mapInArrow(add, _SUMS)


def tally(docs: DataFrame, shared, of: np.ndarray, rare: bool = False) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Under these classes: the class bigrams of known neighbours, the summed counts of the top words by block, and the rows of rarer words."""
    met = written(neighbours(docs, shared, of, rare), "brown-met")
    sums = written(added(added(met.where("block IS NOT NULL"), "block", "part"), "block"), "brown-sums")
    joint = np.zeros(CLASSES * CLASSES, np.int64)
    for r in sums.where("block = -1").collect():  # one row
        joint[np.frombuffer(bytes(r["at"]), np.uint16)] = np.frombuffer(bytes(r["n"]), np.int64)
    return joint.reshape(CLASSES, CLASSES), sums.where("block >= 0"), met


def best_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, now: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """Class of greatest likelihood gain of each word, taken out of its class now. (word, code, n): counts of neighbours' classes, sorted by word from 0."""
    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    gain = np.zeros((len(now), CLASSES))
    for side, cells in ((0, joint.T), (1, joint)):
        own = code // CLASSES == side
        w, c, x = word[own], code[own] % CLASSES, n[own].astype(np.float64)
        total = np.bincount(w, x, len(now))
        size = np.tile(cells.sum(0).astype(np.float64), (len(now), 1))
        size[np.arange(len(now)), now] -= total
        gain -= f(size + total[:, None]) - f(size)
        if len(w):
            base = cells[c].astype(np.float64)
            base[np.arange(len(w)), now[w]] -= x
            base = np.maximum(base, 0.0)
            first = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[first]] += np.add.reduceat(f(base + x[:, None]) - f(base), first, axis=0)
    at = np.argmax(gain[:, : CLASSES - 1], axis=1)
    rows = np.arange(len(now))
    return np.where(gain[rows, at] > gain[rows, now] + 1e-6, at, now)


def likelihood(joint: np.ndarray) -> float:
    """What the classes decide of the log likelihood of the training text."""
    def f(x: np.ndarray) -> float:
        return float((x * np.log(np.maximum(x, 1.0))).sum())

    return f(joint) - f(joint.sum(0)) - f(joint.sum(1))


def exchanged(sums: DataFrame, of: np.ndarray, joint: np.ndarray, size: int) -> np.ndarray:
    """The classes after a sweep over the `size` top words; those of the core stay."""
    shared = sums.sparkSession.sparkContext.broadcast((of, joint))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, joint = shared.value
        for batch in batches:
            for k, at, n in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "n")), strict=True):
                at = np.frombuffer(at, np.uint16).astype(np.int64)
                found = best_classes(at // (2 * CLASSES), at % (2 * CLASSES), np.frombuffer(n, np.int64), of[k * BLOCK : (k + 1) * BLOCK].astype(np.int64), joint)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([found.astype(np.uint8).tobytes()])], names=["block", "found"])

    of = of.copy()
    for k, found in sums.mapInArrow(move, "block int, found binary").collect():  # TOP / BLOCK rows at most
        low, high = max(CORE, k * BLOCK), min(size, (k + 1) * BLOCK)
        if low < high:
            of[low:high] = np.frombuffer(bytes(found), np.uint8)[low - k * BLOCK : high - k * BLOCK]
    return of


def likeliest(after: np.ndarray, before: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The class that makes its neighbours likeliest, for words with these counts of classes after and before them: the gain of best_classes to the first order, as befits words of small counts."""
    cells = joint[: CLASSES - 1].astype(np.float64)
    out, into = np.log(cells.sum(1) + CLASSES), np.log(joint[:, : CLASSES - 1].sum(0) + float(CLASSES))
    value = after @ np.log(cells + 1.0).T + before @ np.log(joint[:, : CLASSES - 1] + 1.0)
    return np.argmax(value - after.sum(1)[:, None] * out - before.sum(1)[:, None] * into, axis=1)


def rare_classes(met: DataFrame, joint: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(word, n, class) of the rarer words by their own neighbours, and the class bigrams of all text: joint and those with a rarer word."""
    shared = met.sparkSession.sparkContext.broadcast(joint)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, more = shared.value, np.zeros((CLASSES, CLASSES), np.int64)
        held, counts = None, np.zeros((1, 4 * CLASSES))  # the word that the rows so far ended with, and its neighbours: after, after and rare, before, before and rare

        def done(names: list, own: np.ndarray) -> pa.RecordBatch:
            after, before = own[:, : 2 * CLASSES], own[:, 2 * CLASSES :]
            found = likeliest(after[:, :CLASSES] + after[:, CLASSES:], before[:, :CLASSES] + before[:, CLASSES:], joint)
            np.add.at(more, found, after[:, :CLASSES].astype(np.int64))
            np.add.at(more.T, found, before[:, :CLASSES].astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(after.sum(1).astype(np.int64)), pa.array(found, pa.int32()), pa.nulls(len(found), pa.binary())], names=["word", "n", "class", "joint"])

        for batch in slices(batches, 4096):
            run = pc.run_end_encode(batch.column("word"))
            names, ends = run.values.to_pylist(), run.run_ends.to_numpy()
            own = np.repeat(np.arange(len(names)), np.diff(ends, prepend=0))
            total = np.zeros((len(names), 4 * CLASSES))
            for at, column in ((0, "after"), (2 * CLASSES, "before")):
                np.add.at(total, (own, batch.column(column).to_numpy() + at), 1.0)
            if held is not None and held == names[0]:
                total[0] += counts[0]
            elif held is not None:
                yield done([held], counts)
            if len(names) > 1:
                yield done(names[:-1], total[:-1])
            held, counts = names[-1], total[-1:]
        if held is not None:
            yield done([held], counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([more.tobytes()])], names=["word", "n", "class", "joint"])

    single = met.where("word IS NOT NULL AND other IS NULL").select("word", "before", "after").repartition("word").sortWithinPartitions("word")
    found = written(single.mapInArrow(assign, "word string, n long, class int, joint binary"), "brown-classes")
    rare, whole = found.where("word IS NOT NULL").select("word", "n", "class"), joint.copy()
    for r in found.where("word IS NULL").select("joint").toLocalIterator():
        whole += np.frombuffer(bytes(r["joint"]), np.int64).reshape(CLASSES, CLASSES)
    left, right = rare.select("word", F.col("class").alias("l")), rare.select(F.col("word").alias("other"), F.col("class").alias("r"))
    pairs = met.where("other IS NOT NULL").select("word", "other").join(left, "word").join(right, "other")
    for l, r, n in written(pairs.groupBy("l", "r").agg(F.count("*")), "brown-pairs").collect():  # CLASSES * CLASSES rows at most
        whole[l, r] += n
    return rare, whole


@dataclass
class Model:
    """What scoring needs besides the counts of rarer words."""

    top: dict[bytes, int]  # rank by word
    log_counts: np.ndarray  # log10(count + 1) by rank
    of: np.ndarray  # class by word number: rank, or TOP plus unit
    steps: np.ndarray  # log10 P(class | class before)
    weights: np.ndarray  # log10 of what a count + 1 is divided by in each class
    n_docs: int
    tokens: int
    types: int
    history: list[float]  # log likelihood of the class bigrams of known neighbours before the sweeps and after each


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of docs (text), and the counts and classes of the words below the top ones (word, n, class); null texts count as empty."""
    vocabulary = written(word_counts(docs), "brown-words")
    n_docs = docs.count()
    top = top_words(vocabulary)
    rank = {w: k for k, (w, _) in enumerate(top)}
    words_, tokens = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shared = docs.sparkSession.sparkContext.broadcast(in_order(rank))
    classes = exchange(unit_bigrams(docs, dict(list(rank.items())[:CORE])))
    unit = np.concatenate([np.arange(min(CORE, len(top))), endings(pa.array([w for w, _ in top[CORE:]], pa.binary())), np.zeros(TOP - len(top))]).astype(np.int64)
    of, some_rare = np.concatenate([classes[unit], classes]), words_ > len(top)
    rounds = ROUNDS if len(top) > CORE else 0
    joint, sums, met = tally(docs, shared, of, some_rare and not rounds)
    history = [likelihood(joint)]
    for k in range(rounds):
        after = exchanged(sums, of, joint, len(top))
        joint_after, sums_after, met_after = tally(docs, shared, after, some_rare and k == rounds - 1)
        history.append(likelihood(joint_after))
        if history[-1] <= history[-2]:
            release(met_after)
            if some_rare:
                joint, sums, met = tally(docs, shared, of, True)
            break
        release(met)
        of, joint, sums, met = after, joint_after, sums_after, met_after
    rare, joint = rare_classes(met, joint)
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(n_class, of[: len(top)], [n for _, n in top])
    np.add.at(v_class, of[: len(top)], 1)
    for c, n, v in rare.groupBy("class").agg(F.sum("n"), F.count("*")).collect():
        n_class[c] += n
        v_class[c] += v
    n_class[of[TOP + END]] += n_docs
    v_class[of[TOP + END]] += 1 if n_docs else 0
    joint = joint.astype(np.float64)
    share = (n_class + 1.0) / (n_class.sum() + CLASSES)
    steps = np.log10((joint + share) / (joint.sum(1, keepdims=True) + 1.0))
    log_counts = np.concatenate([np.log10(np.array([n for _, n in top], np.float64) + 1.0), np.zeros(TOP - len(top) + UNITS)])
    model = Model(rank, log_counts, of.astype(np.int16), steps, np.log10(n_class + v_class + 1.0), n_docs, int(tokens) + n_docs, words_ + (1 if n_docs else 0), history)
    return model, rare


def score(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, base_perplexity, perplexity) for every row of docs (doc_id, text).

    base_score is the add-one unigram log10 probability, score that of the class model. A null text counts as empty: one token, the end. Repeated rows are
    scored alike, null ids pass through, other columns are ignored, an empty table gives no rows.
    """
    # an Arrow array of words takes a tenth of the memory of a dictionary in every worker
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, top=in_order(model.top)))
    names = ["row", "doc_id", "n_tokens", "known", "counts", "model", "word", "own", "before", "after", "left", "left_own", "right", "right_own"]
    texts = ("word", "left", "right")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index, row = m.top, TaskContext.get().partitionId() << 33
        end_count = math.log10(m.n_docs + 1)
        for part in slices(batches, TEXTS):
            t = _Texts(part.column("text"), index)
            c = m.of[t.u]
            pair = np.flatnonzero(t.known[:-1] & t.known[1:] & t.inner)
            edges, logs, top = np.zeros(len(t.u)), np.zeros(len(t.u)), np.zeros(len(t.u), np.int64)
            edges[pair] = m.steps[c[pair], c[pair + 1]] - m.weights[c[pair + 1]]
            logs[t.place] = m.log_counts[t.u[t.place]]
            top[t.place] = t.u[t.place] < TOP
            at, names_, two, left, right = t.rare()
            beside = np.where(t.known, c, -1)
            cut = [pa.array(np.append(np.searchsorted(x, t.first), len(x)), pa.int32()) for x in (at, two)]
            flat = [(0, names_), (0, c[at]), (0, beside[at - 1]), (0, beside[at + 1])]
            flat += [(1, left), (1, c[two]), (1, right), (1, c[two + 1])]
            lists = [pa.ListArray.from_arrays(cut[k], x if isinstance(x, pa.Array) else pa.array(x.astype(np.int32))) for k, x in flat]
            plain = [np.arange(row, row + len(t.n)), part.column("doc_id"), t.n + 1, t.by_text(top) + (1 if m.n_docs else 0), t.by_text(logs) + end_count, t.by_text(edges)]
            row += len(t.n)
            yield pa.RecordBatch.from_arrays([*[x if isinstance(x, pa.Array) else pa.array(x) for x in plain], *lists], names=names)

    more = "row long, known_more long, counts_more double, model_more double"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            n = b.column("n").fill_null(0).to_numpy()
            c, before, after = (b.column(x).to_numpy() for x in ("class", "before", "after"))
            value = np.where(before >= 0, m.steps[before, c] - m.weights[c], 0.0) + np.where(after >= 0, m.steps[c, after] - m.weights[after], 0.0)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array((n > 0).astype(np.int64)), pa.array(np.log10(n + 1.0)), pa.array(value)], names=["row", "known_more", "counts_more", "model_more"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            left, right = (b.column(x).to_numpy() for x in ("l", "r"))
            none = np.zeros(len(left))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(none.astype(np.int64)), pa.array(none), pa.array(m.steps[left, right] - m.weights[right])], names=["row", "known_more", "counts_more", "model_more"])

    # rarer words and the sums of exploded lists grow with the corpus, whatever size Spark guesses: merged, not sent through the driver
    arrays = ", ".join(f"{n} array<{'string' if n in texts else 'int'}>" for n in names[6:])
    walked = written(docs.select("doc_id", "text").mapInArrow(walk, f"row long, doc_id long, n_tokens long, known long, counts double, model double, {arrays}"), "brown-rows")
    single = walked.select("row", F.explode(F.arrays_zip("word", "own", "before", "after")).alias("x")).select("row", "x.*").join(rare.hint("merge"), "word", "left")
    single = single.select("row", F.coalesce("class", "own").alias("class"), "before", "after", "n").mapInArrow(add, more)
    pairs = walked.select("row", F.explode(F.arrays_zip("left", "left_own", "right", "right_own")).alias("x")).select("row", "x.*")
    for side in ("left", "right"):
        pairs = pairs.join(rare.select(F.col("word").alias(side), F.col("class").alias(side[0])).hint("merge"), side, "left").withColumn(side[0], F.coalesce(side[0], f"{side}_own"))
    pairs = pairs.select("row", "l", "r").mapInArrow(step, more)
    extra = single.unionByName(pairs).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known_more", "counts_more", "model_more")])
    both = walked.drop(*names[6:]).join(extra.hint("merge"), "row", "left")
    counts = F.col("counts") + F.coalesce("counts_more", F.lit(0.0))
    base = counts - F.col("n_tokens") * math.log10(model.tokens + model.types + 1)
    score = counts + F.col("model") + F.coalesce("model_more", F.lit(0.0))
    known = F.col("known") + F.coalesce("known_more", F.lit(0))
    scored = both.select("doc_id", "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
    return scored.withColumn("base_perplexity", F.pow(F.lit(10.0), -F.col("base_score") / F.col("n_tokens"))).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
