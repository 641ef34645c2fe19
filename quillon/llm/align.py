"""Alignment of two tokenizers over the same text, by whitespace-token anchors.

A blank between a character that is no blank and one that is no white space begins a token of either tokenizer, whatever stands around it, if the piece model merges pairs, takes text as it is and has
no piece that goes on over such a blank (`Pieces.apart` reads this off the model). These blanks are the anchors: they cut a text into windows, nearly all of a word each, whose tokens in the text are those that
they have alone. So a window is tokenised, verified and aligned once in a block and remembered by its text: groups (cut wherever tokens of both end) and links (tokens whose bytes overlap).
With any other piece model a text is tokenised as a whole by both; where a byte offset ends a token of either and the next token of either bears the space mark, it is an anchor, and windows are
remembered by their ids. Documents are kept as counts of windows.

How many documents hold a linked id pair is counted in two steps. A task cuts its documents into blocks of bounded size, each with a list of its own windows and
distinct pairs; only a block's distinct pairs are shuffled, with the number of its documents that hold them. The sums go back to each block once, which adds
them up by window and then by document.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices, written

#: A block ends with the document that takes it past one of these: documents, windows remembered, links in them.
DOCUMENTS, WINDOWS, LINKS = 16_384, 400_000, 6_000_000
#: Stands between the ids of either side in the key of a window; no id is as large.
_BETWEEN = 0xFFFFFFFF
#: Fixed value: the anchors of a text.
_ANCHOR = re.compile(r"(?<=[^ ]) (?=\S)")
#: Windows that are tokenised at once, at most.
_TOGETHER = 4096
#: Entries of a row of a block's lists.
CHUNK = 16_384


def _byte_of_letter() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means: printable bytes stand for themselves, the rest take letters from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokens:
    """What is known of a vocabulary's tokens: bytes, their number, whether they begin with a blank; ids in decimal with a comma, then all again with the mark that ends a row of them."""

    def __init__(self, names: list[bytes], mark: str):
        self.names = names
        self.width = np.array([len(n) for n in names], np.int64)
        self.digits = [f"{i}{m}" for m in (",", mark) for i in range(len(names))]
        self.spaced = np.array([n[:1] == b" " for n in names])

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.names.__getitem__, ids))


class ByteLevel(Tokens):
    """A byte-level BPE vocabulary file. Its special tokens are plain text; ids are those of the tokenizers library, found by the faster tiktoken over the file's own merges."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, special = _byte_of_letter(), {x["id"] for x in data["added_tokens"]}
        ids = {bytes(letters[c] for c in t): i for t, i in data["model"]["vocab"].items() if i not in special}
        before = -1
        for pair in data["model"]["merges"]:  # ids must rise with the order of merges, since they serve as ranks
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            before, last = ids[bytes(letters[c] for c in a + b)], before
            if before <= last:
                raise ValueError(f"{path}: ids do not follow the merges")
        names = [b""] * (max(ids.values()) + 1)
        for name, i in ids.items():
            names[i] = name
        super().__init__(names, "|")
        self.encoder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.encoder.encode_ordinary(" " + text)


class Pieces(Tokens):
    """A sentencepiece model, which adds the blank before a text by itself. apart: whether its tokens never depend on what stands beyond an anchor."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        names = [bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]
        super().__init__(names, ";")
        held = sentencepiece_model_pb2.ModelProto.FromString(m.serialized_model_proto())
        how, form = held.trainer_spec, held.normalizer_spec
        plain = form.add_dummy_prefix and form.escape_whitespaces and not (form.remove_extra_whitespaces or form.precompiled_charsmap or how.treat_whitespace_as_suffix)
        self.apart = how.model_type == how.BPE and plain and not any(re.search("[^▁]▁", x.piece) for x in held.pieces)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    """One pair for each worker process."""
    return ByteLevel(a_path), Pieces(b_path)


class Block:
    """Windows and id pairs that some documents hold, each by a number of its own."""

    def __init__(self, va: Tokens, vb: Tokens, most: int = DOCUMENTS):
        self.va, self.vb, self.most = va, vb, most
        self.digits = va.digits + vb.digits
        self.letters = np.array(list(map(len, self.digits)))
        self.number: dict[bytes | str, int] = {}  # -1: its tokens do not give its bytes back
        self.text: list[str] = []
        self.n_a, self.n_b = array("i"), array("i")
        self.groups, self.links, self.start = array("i"), array("i"), array("q")  # of each window; start is its first link's place in pairs
        self.pairs = array("i")
        self.pair: dict[int, int] = {}
        self.holding, self.place = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.documents = 0

    def full(self) -> bool:
        return self.documents >= self.most or len(self.number) >= WINDOWS or len(self.pairs) >= LINKS

    def _learn(self, keys: list, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        """Align new windows, whose ids follow one another in a and b, so many of each: where a token of either ends, one link does; where tokens of both end, a group does."""
        ends_a, ends_b = np.cumsum(self.va.width[a]), np.cumsum(self.vb.width[b])
        ending = np.zeros(ends_a[-1] + 1, np.uint8)
        ending[ends_a] += 1
        ending[ends_b] += 1
        ends, done = np.flatnonzero(ending), np.flatnonzero(ending == 2)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        of_a, of_b = np.searchsorted(done, ends_a), np.searchsorted(done, ends_b)  # the groups of the tokens
        row = np.empty(len(a) + len(b), np.int64)  # of each group the ids a, then the ids b
        row[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = a + len(self.va.names) * (done[of_a] == ends_a)
        row[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = b + len(self.vb.names) * (done[of_b] == ends_b) + len(self.va.digits)
        text, edges = "".join(map(self.digits.__getitem__, row.tolist())), np.cumsum(self.letters[row])[np.cumsum(n_a + n_b) - 1].tolist()
        self.text += [text[p : q - 1] for p, q in zip([0, *edges], edges, strict=False)]

        linked, pair = ((a[at_a] << 32) | b[at_b]).tolist(), self.pair
        places = list(map(pair.get, linked))
        if None in places:
            places = [pair.setdefault(k, len(pair)) for k in linked]
        last = ends_a[np.cumsum(n_a) - 1]
        links, groups = (np.diff(np.searchsorted(x, last, "right"), prepend=0) for x in (ends, done))
        for own, more in ((self.start, len(self.pairs) + np.cumsum(links) - links), (self.pairs, places), (self.n_a, n_a), (self.n_b, n_b), (self.groups, groups), (self.links, links)):
            own.frombytes(np.asarray(more, own.typecode).tobytes())
        self.number.update(zip(keys, range(len(self.text) - len(keys), len(self.text)), strict=True))

    def windows(self, text: str) -> list[int] | None:
        """Window numbers of a text; None, or one of -1 among them, if either tokenizer does not give its bytes back."""
        if not self.vb.apart:
            return self._windows_of_ids(text)
        keys = text.split(" ")
        found = list(map(self.number.get, keys))
        if None in found:
            new = [k for k, n in zip(keys, found, strict=True) if n is None]
            if any(not k or k[0].isspace() for k in new):  # other white space beside a blank, or several blanks
                keys = _ANCHOR.split(text)
                if text[0].isspace():
                    keys[0] = " " + keys[0]  # no such key comes from a split at all blanks, which would cut wrongly here
                new = [k for k in keys if k not in self.number]
            new = list(dict.fromkeys(new))
            for at in range(0, len(new), _TOGETHER):
                self._meet(new[at : at + _TOGETHER])
            found = list(map(self.number.get, keys))
        return found

    def _meet(self, keys: list[str]) -> None:
        """Number windows of these texts, met for the first time in the block; only the first may begin with white space. They are tokenised as one text."""
        texts = [k[1:] if k[0] == " " else k for k in keys]
        text = " ".join(texts)
        raw, sizes = b" " + text.encode(), [len(t) for t in texts] if text.isascii() else [len(t.encode()) for t in texts]
        a, b = self.va.encode(text), self.vb.encode(text)
        if self.va.joined(a) == raw == self.vb.joined(b):
            a, b, last = np.array(a, np.int64), np.array(b, np.int64), np.cumsum(sizes) + np.arange(1, len(sizes) + 1)
            n_a, n_b = (np.diff(np.searchsorted(np.cumsum(v.width[x]), last, "right"), prepend=0) for v, x in ((self.va, a), (self.vb, b)))
            self._learn(keys, a, n_a, b, n_b)
        elif len(keys) == 1:
            self.number[keys[0]] = -1
        else:
            for k in keys:
                self._meet([k])

    def _windows_of_ids(self, text: str) -> list[int] | None:
        """windows() by a piece model whose tokens may depend on what stands beyond an anchor."""
        raw = b" " + text.encode()
        a, b = self.va.encode(text), self.vb.encode(text)
        if self.va.joined(a) != raw or self.vb.joined(b) != raw:
            return None
        sides, anchored = [], np.zeros(len(raw) + 1, np.uint8)
        for own, v in ((a, self.va), (b, self.vb)):
            ids = np.array(own, np.uint32)
            marked = np.flatnonzero(v.spaced[ids[1:]])
            ends = np.cumsum(v.width[ids])[marked]
            anchored[ends] += 1
            sides.append((ids, ends, marked))
        cut_a, cut_b = (np.concatenate([[0], marked[anchored[ends] == 2] + 1, [len(ids)]]) for ids, ends, marked in sides)
        window = np.arange(len(cut_a))
        row = np.full(len(a) + len(b) + len(cut_a) - 1, _BETWEEN, np.uint32)  # of each window the ids a, a mark, the ids b
        row[np.arange(len(a)) + np.repeat((cut_b + window)[:-1], np.diff(cut_a))] = sides[0][0]
        row[np.arange(len(b)) + np.repeat((cut_a + window)[1:], np.diff(cut_b))] = sides[1][0]
        row, edges = row.tobytes(), (4 * (cut_a + cut_b + window)).tolist()
        keys = [row[p:q] for p, q in zip(edges, edges[1:], strict=False)]
        for k, key in enumerate(keys):
            if key not in self.number:
                (p, q), (x, y) = cut_a[k : k + 2], cut_b[k : k + 2]
                self._learn([key], sides[0][0][p:q].astype(np.int64), np.array([q - p]), sides[1][0][x:y].astype(np.int64), np.array([y - x]))
        return list(map(self.number.get, keys))

    def add(self, text: str, times: int) -> tuple | None:
        """What align() needs of a document that occurs so many times: (n_a, n_b, n_groups, n_links, groups, window numbers, their counts)."""
        self.documents += times
        found = self.windows(text) if text else None
        if found is None:
            return None
        own, counts = np.unique(np.array(found, np.int32), return_counts=True)
        if own[0] < 0:
            return None
        n_a, n_b, groups, links = (np.frombuffer(x, np.int32)[own].astype(np.int64) for x in (self.n_a, self.n_b, self.groups, self.links))
        at = np.repeat(np.frombuffer(self.start, np.int64)[own] - np.cumsum(links) + links, links) + np.arange(links.sum())
        held = np.frombuffer(self.pairs, np.int32)[at]
        if len(self.holding) < len(self.pair):
            self.holding, self.place = (np.concatenate([x, np.zeros(max(len(self.pair), len(x)), np.int64)]) for x in (self.holding, self.place))
        places = np.arange(len(held))
        self.place[held] = places
        self.holding[held[self.place[held] == places]] += times  # each pair once, at the one place of it that was kept
        return *(int((x * counts).sum()) for x in (n_a, n_b, groups, links)), ";".join([self.text[w] for w in found]), own, counts.astype(np.int32)

    def lists(self) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, number of the first, x, y, z) in chunks: pairs as ids a, ids b and documents; windows as their numbers of links and the links' pairs."""
        if not self.pair:
            return
        ids = np.array(list(self.pair), np.int64)
        for at in range(0, len(ids), CHUNK):
            some = ids[at : at + CHUNK]
            yield "pairs", at, (some >> 32).astype(np.int32), (some & 0xFFFFFFFF).astype(np.int32), self.holding[at : at + len(some)].astype(np.int32)
        links, pairs, first = np.array(self.links, np.int32), np.array(self.pairs, np.int32), 0
        for at in range(0, len(links), CHUNK):
            some = links[at : at + CHUNK]
            yield "windows", at, some, pairs[first : first + some.sum()], np.zeros(0, np.int32)
            first += some.sum()


_ROWS = "block long, kind string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, first int, x array<int>, y array<int>, z array<int>"
_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _ROWS.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _blocks(docs: DataFrame, a_path: str, b_path: str, digest: bool, most: int) -> DataFrame:
    """Rows of documents, and of the lists of the blocks that they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = vocabularies(a_path, b_path)
        number, block = TaskContext.get().partitionId() << 32, Block(va, vb, most)
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            times = {}
            for t in texts:
                times[t] = times.get(t, 0) + 1
            made, waiting = {}, list(zip(part.column("doc_id").to_pylist(), texts, strict=True))
            for t, n in times.items():  # copies in a slice are worked out once
                done = block.add(t, n)
                made[t] = (number, done)
                if block.full():
                    yield from ending(number, block)
                    number, block = number + 1, Block(va, vb, most)
            rows = []
            for doc_id, t in waiting:
                at, done = made[t]
                if done is None:
                    rows.append((at, "document", doc_id, 0, 0, 0, 0, "", 0, [], [], None))
                else:
                    groups = hashlib.sha256(done[4].encode()).hexdigest() if digest else done[4]
                    rows.append((at, "document", doc_id, *done[:4], groups, 0, done[5], done[6], None))
            yield _batch(rows)
        yield from ending(number, block)

    def ending(number: int, block: Block) -> Iterator[pa.RecordBatch]:
        for kind, at, x, y, z in block.lists():
            yield _batch([(number, kind, None, None, None, None, None, None, at, x, y, z)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROWS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, documents, highest): how many documents hold each linked id pair, and whether no pair of its id a is held by more."""
    entry = F.posexplode(F.arrays_zip("x", "y", "z")).alias("at", "e")
    entries = blocks.where("kind = 'pairs'").select(entry).select(F.col("e.x").alias("a"), F.col("e.y").alias("b"), F.col("e.z").alias("n"))
    counts = entries.groupBy("a", "b").agg(F.sum("n").alias("documents"))
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(most, "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("highest"))


def _add_up(held: pa.Table, known: pa.Table) -> pa.Table:
    """Documents of a block with the sums of their links: known has (first, count, highest) of its pairs."""
    kind = np.array(held["kind"].to_pylist())
    total, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
    at = known["number"].to_numpy()
    total[at], best[at] = known["documents"].to_numpy(), known["highest"].to_numpy(zero_copy_only=False)
    by_window, chunks = [], sorted(np.flatnonzero(kind == "windows").tolist(), key=lambda i: held["first"][i].as_py())
    for i in chunks:
        size, pairs = (held[c][i].values.to_numpy() for c in ("x", "y"))
        starts = np.cumsum(size) - size
        by_window.append((np.add.reduceat(total[pairs], starts), np.add.reduceat(best[pairs], starts)))
    sums = [np.concatenate([w[k] for w in by_window]) if by_window else np.zeros(0, np.int64) for k in (0, 1)]
    docs = held.filter(pa.array(kind == "document"))
    out = []
    for x, y in zip(docs["x"], docs["y"], strict=True):
        w, c = x.values.to_numpy(), y.values.to_numpy()
        out.append([int((s[w] * c).sum()) for s in sums] if len(w) else [0, 0])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    more = [pa.array([r[1] for r in out], pa.int64()), pa.array([r[0] for r in out], pa.int64()), docs["groups"]]
    return pa.table([*[docs[c] for c in names], *more], names=[*names, "n_best", "count_sum", "groups"])


def align(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, most: int = DOCUMENTS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for every row of docs (doc_id, text).

    a_path is a byte-level vocabulary file, b_path a sentencepiece model; every executor has both. groups lists the groups as `a1,a2|b1;a3|b2,b3`, or with digest its
    sha256. count_sum adds up over all links how many documents hold their id pair linked; n_best counts the links whose pair is held by as many documents as any of its id a.
    A text that is null, empty, or not given back by its tokens has none: zeros and empty groups. Repeated rows are documents of their own; other columns are ignored;
    an empty table gives no rows. A text without blanks is one window. A block ends after `most` documents at the latest; the result does not depend on it.
    """
    blocks = written(_blocks(docs, a_path, b_path, digest, most), "align-blocks")
    own = blocks.where("kind = 'pairs'").select("block", "first", F.posexplode(F.arrays_zip("x", "y")).alias("at", "e"))
    own = own.select("block", (F.col("first") + F.col("at")).alias("number"), F.col("e.x").alias("a"), F.col("e.y").alias("b"))
    known = own.join(pair_counts(blocks), ["a", "b"]).select(F.col("block").alias("of"), "number", "documents", "highest")
    held = blocks.where("kind <> 'pairs'").select("block", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "first", "x", "y")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return held.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_add_up, out)
