import random
from bisect import bisect_right
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Libraries:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in kept} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in kept)}
        self.a_bytes = {i: bytes(letters.get(c, 0) for c in t) for t, i in self.a.get_vocab().items()}

    def ids(self, text):
        return self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


def brute(texts, lib):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), from the libraries' ids and all pairs of overlapping byte ranges."""
    links, plain, counts = [], [], Counter()
    for text in texts:
        a, b = lib.ids(text) if text else ([], [])
        ab, bb = [lib.a_bytes[i] for i in a], [lib.b_bytes(i) for i in b]
        if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            links.append([])
            plain.append((0, 0, 0, ""))
            continue
        ends = [[0], [0]]
        for own, found in zip((ab, bb), ends, strict=True):
            for x in own:
                found.append(found[-1] + len(x))
        shared = sorted(set(ends[0]) & set(ends[1]) - {0})
        groups = [[[], []] for _ in shared]
        for side, ids in enumerate((a, b)):
            for i, e in zip(ids, ends[side][1:], strict=True):
                groups[next(k for k, s in enumerate(shared) if s >= e)][side].append(i)
        own = []
        for i, (start, end) in enumerate(zip(ends[0], ends[0][1:], strict=False)):
            j = bisect_right(ends[1], start) - 1
            while j < len(b) and ends[1][j] < end:
                own.append((a[i], b[j]))
                j += 1
        links.append(own)
        counts.update(set(own))
        plain.append((len(a), len(b), len(groups), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(*p[:3], len(own), sum(counts[k] == best[k[0]] for k in own), sum(counts[k] for k in own), p[3]) for p, own in zip(plain, links, strict=True)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("most", [3, 8192])
def test_documents_as_by_brute_force(documents, libraries, most):
    """Whatever the size of the blocks; nulls, empty and long texts, copies and repeated rows."""
    rows = documents.collect()
    want = sorted(str((r["doc_id"], *w)) for r, w in zip(rows, brute([r["text"] for r in rows], libraries), strict=True))
    got = align.align(documents, A, B, most=most).collect()
    assert sorted(str((r["doc_id"], *(r[c] for c in COLUMNS))) for r in got) == want


def test_odd_texts(spark, libraries):
    rng = random.Random(4)
    letters = [*"aàâΣςσ'sdİıß\x1c\x85\xa0​　ﬁ1½Ⅷ--..\n\t 😀👍🏽é語한अ\x00 th  ee", "<|endoftext|>", "<s>", "<0x41>", "'ll", " the", " token", "aaaa"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(400)] + ["▁", "a▁b", " ", "\n", "x" * 3000, "語" * 900, "ab" * 500 + " the end"]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).collect()}
    for i, want in enumerate(brute(texts, libraries)):
        assert got[i] == want, texts[i]


def test_windows_are_remembered(libraries):
    va, vb = align.vocabularies(A, B)
    block = align.Block(va, vb)
    block.add("some words that come again and some words that come again", 1)
    before = len(block.number)
    block.add("again and some words that come", 2)
    assert before > 5 and len(block.number) == before
    assert block.holding[: len(block.pair)].max() == 3


def test_the_file_gives_the_librarys_ids(libraries):
    """Letters of all kinds, alone and beside others."""
    va, _ = align.vocabularies(A, B)
    rng = random.Random(9)
    codes = [c for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]
    for _ in range(1500):
        text = "".join(x for c in rng.sample(codes, 12) for x in (chr(c), rng.choice(["", " ", "a", "1", "!"])))
        assert va.encode(text) == libraries.a.encode(" " + text, add_special_tokens=False).ids, text


def test_digest_and_empty_table(documents, no_documents):
    import hashlib

    some = documents.where("doc_id < 3")
    texts = {r["doc_id"]: r["groups"] for r in align.align(some, A, B).collect()}
    assert {r["doc_id"]: r["groups"] for r in align.align(some, A, B, digest=True).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in texts.items()}
    assert align.align(no_documents, A, B).count() == 0
