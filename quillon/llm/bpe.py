"""BPE encoding and decoding by a prefix-sharing trie traversal.

The encoding of a prefix ends in one token only, and a row of tokens is the encoding of its text exactly if each two neighbours stay
apart when merged by themselves. So a word is encoded by the last token of each of its prefixes: the one token that ends the prefix and
goes with the last token of what precedes it. Distinct words of a batch, in sorted order, are the depth-first order of their trie;
a stack holds the last token of each prefix on the path, and a word computes only the prefixes that it does not share with the word before it. Which tokens end
a prefix at all is read off an Aho-Corasick automaton of the vocabulary, whose node stands on the stack beside the token. No text is
shuffled: every task encodes the distinct words of its own rows once, through a word memory of bounded size.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices

#: Words whose encodings a worker remembers, at most twice as many; pairs of tokens. Long words are not remembered, so this bounds memory too.
MEMORY, LONG = 100_000, 64
#: Fixed value: the white space that the vocabulary's patterns know.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: how the vocabulary splits text into words.
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_END = "</w>"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it is printable, else the next letter from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A word-end BPE vocabulary file and the encodings of the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids: dict[str, int] = data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.names: dict[int, str] = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        size = max(self.names) + 1
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = ids[a + b]
            if self.rank[whole] < 0:
                self.left[whole], self.right[whole], self.rank[whole] = ids[a], ids[b], rank
            self.merge.setdefault((ids[a], ids[b]), rank)
        middle: dict[str, int] = {}
        final: dict[str, int] = {}
        reached: dict[int, bool] = {}
        for name, i in sorted(ids.items(), key=lambda x: self.rank[x[1]]):
            a, b = self.left[i], self.right[i]
            reached[i] = a < 0 or (reached[a] and reached[b] and self._apart(a, b, self.rank[i]))
            if reached[i]:
                if name.endswith(_END) and len(name) > len(_END):
                    final[name[: -len(_END)]] = i
                else:
                    middle[name] = i
        self.digits = [str(i) for i in range(size)]
        self.size = [self.width(i) if i in self.names else 0 for i in range(size)]
        self._automaton(middle, final)
        self.letters = {b: c for b, c in _byte_letters().items() if chr(b) != c}
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def _apart(self, a: int, b: int, own: int = -1) -> bool:
        """Whether no merge crosses the border between tokens a and b.

        Goes back in time along the right edge of a and the left edge of b: of the two parts at the border the one made later is taken
        apart, and a crossing merge of the parts would have come first if its rank is lower (or, where b's part is taken apart, equal, since
        the leftmost of equal merges comes first). own: the merge of a and b themselves, if it is the one asked about.
        """
        if own < 0 and (a, b) in self.merge:
            return False
        while True:
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if rb >= ra:
                b, before = self.left[b], rb + 1
            else:
                a, before = self.right[a], ra
            if self.merge.get((a, b), before) < before:
                return False

    def apart(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(a, b)
        return found

    def _automaton(self, middle: dict[str, int], final: dict[str, int]) -> None:
        """Nodes are the beginnings of tokens. next leads from a node by a letter, shorter to the longest proper ending of a node that is one itself; inner and last are the tokens that end a node, longest first."""
        self.next: dict[int, int] = {}
        self.shorter, self.inner, self.last = array("i", [0]), [()], [()]
        level = [(0, name) for name in middle.keys() | final.keys()]
        at = 0
        while level:
            deeper = []
            for node, name in level:
                key = node << 9 | ord(name[at])
                found = self.next.get(key)
                if found is None:
                    found = self.next[key] = len(self.inner)
                    short = self._step(self.shorter[node], name[at]) if node else 0
                    self.shorter.append(short)
                    self.inner.append(self.inner[short])
                    self.last.append(self.last[short])
                if at + 1 < len(name):
                    deeper.append((found, name))
                    continue
                if name in middle:
                    self.inner[found] = (middle[name], *self.inner[found])
                if name in final:
                    self.last[found] = (final[name], *self.last[found])
            level, at = deeper, at + 1

    def _step(self, node: int, letter: str) -> int:
        """The node of the longest ending of node and letter that has one."""
        code = ord(letter)
        while (found := self.next.get(node << 9 | code)) is None and node:
            node = self.shorter[node]
        return found or 0

    def _last(self, table: list[tuple[int, ...]], word: str, end: int, state: list[tuple[int, int]]) -> tuple[int, int]:
        """The last token of word[:end], out of those that table has for its node, and that node; state[i] has those of word[:i]."""
        code, node = ord(word[end - 1]), state[end - 1][1]
        while (found := self.next.get(node << 9 | code)) is None and node:
            node = self.shorter[node]
        node, pairs, size = found or 0, self.pairs, self.size
        for token in table[node]:
            start = end - size[token]
            if start == 0:
                return token, node
            before = state[start][0]
            known = pairs.get(before << 20 | token)
            if known or (known is None and self.apart(before, token)):
                return token, node
        raise ValueError(f"no token ends {word[:end]!r}")

    def width(self, token: int) -> int:
        name = self.names[token]
        return len(name) - len(_END) if name.endswith(_END) and len(name) > len(_END) else len(name)

    def traverse(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words in the stand-in alphabet, given in sorted order."""
        state, before, size = [(-1, 0)], "", self.size
        for word in words:
            common, most = 0, min(len(before), len(word), len(state) - 1)
            while common < most and before[common] == word[common]:
                common += 1
            del state[common + 1:]
            for end in range(len(state), len(word)):
                state.append(self._last(self.inner, word, end, state))
            token, end, ids = self._last(self.last, word, len(word), state)[0], len(word), []
            while True:
                ids.append(token)
                end -= size[token]
                if end <= 0:
                    break
                token = state[end][0]
            yield word, ids[::-1]
            before = word

    def _joined(self, ids: Iterable[int]) -> tuple[str, str]:
        return " ".join([self.digits[i] for i in ids]), " ".join([self.names[i] for i in ids])

    def learn(self, words: Iterable[str]) -> dict[str, tuple[str, str]]:
        """(ids, names of the tokens), joined by blanks, of words as met in texts."""
        stand_in = {w if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters): w for w in words}
        return {stand_in[mapped]: self._joined(ids) for mapped, ids in self.traverse(sorted(stand_in))}

    def split(self, text: str) -> list[str]:
        """Words of a text and special tokens, which stand for themselves."""
        out: list[str] = []
        for part in self.at_special.split(text) if self.at_special and "<|" in text else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                part = unicodedata.normalize("NFC", part)
                part = "".join([c.lower() for c in part]) if "Σ" in part else part.lower()
                out += _SPLIT.findall(part)
        return out

    def remembered(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """What learn gives, for each of words and special tokens. Those met lately are kept in two generations: words of the older one that are met again move to the younger one."""
        found = {w: self.young.get(w) or self.old.get(w) or (self._joined([self.special[w]]) if w in self.special else None) for w in words}
        found |= self.learn([w for w, known in found.items() if known is None])
        if len(self.young) > MEMORY:
            self.young, self.old = {}, self.young
        self.young.update((w, known) for w, known in found.items() if len(w) <= LONG)
        return found

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids joined by blanks, decoded text) of each text."""
        split = [self.split(t) for t in texts]
        found = self.remembered(set(chain.from_iterable(split))).__getitem__
        for ws in split:
            made = list(map(found, ws))
            yield " ".join([ids for ids, _ in made]), " ".join([names for _, names in made])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row of docs (doc_id, text): ids in decimal joined by one blank, and what they decode to.

    path is a vocabulary file that every executor has. A null text counts as empty and has no tokens. Repeated rows are encoded like
    any other; other columns are ignored; an empty table gives no rows. Texts are taken in slices of bounded size, so that very long ones
    do not meet in memory.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for part in slices(batches):
            ids, decoded = zip(*voc.encode([x or "" for x in part.column("text").to_pylist()]), strict=True)
            counts = [x.count(" ") + 1 if x else 0 for x in ids]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], schema=out)

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids string, decoded string")


def token_ids(ids: str = "ids"):
    """The ids of encode_decode as an array."""
    return F.when(F.col(ids) == "", F.array().cast("array<int>")).otherwise(F.split(ids, " ").cast("array<int>"))
