import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_documents_encode_and_decode_as_the_library_does(documents, library):
    for r, text in zip(*(lambda d: (bpe.encode_decode(d, PATH).collect(), [x["text"] for x in d.collect()]))(documents.coalesce(1)), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert r["ids"] == " ".join(map(str, ids)) and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_odd_texts(library):
    rng = random.Random(2)
    letters = "aàâΣςσ'sdlİıß\x1c\x85​　ﬁ1½Ⅷ--..\n\t 😀👍🏽é语한अ\x00tthhee"
    texts = ["".join(rng.choice([*letters, "<|endoftext|>", "'ll", "I'VE", "aaaa"]) for _ in range(rng.randrange(50))) for _ in range(500)] + ["a" * 5000, "ab" * 3000]
    voc = bpe.Vocabulary(PATH)
    for text, (ids, decoded) in zip(texts, voc.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), text
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_a_shared_prefix_is_computed_once():
    voc, calls = bpe.Vocabulary(PATH), []
    last = voc._last
    voc._last = lambda table, word, end, state: calls.append(word[:end]) or last(table, word, end, state)
    list(voc.traverse(sorted(["interesting", "interested", "interests", "interest"])))
    inner = [c for c in calls if len(c) <= len("interes")]
    assert len(inner) == len(set(inner))


def test_empty_table(no_documents):
    assert bpe.encode_decode(no_documents, PATH).count() == 0


def test_only_tokens_that_end_a_prefix_are_looked_at(library):
    voc, looked = bpe.Vocabulary(PATH), 0

    class Counted(list):
        def __getitem__(self, node):
            nonlocal looked
            looked += len(list.__getitem__(self, node))
            return list.__getitem__(self, node)

    voc.inner, voc.last = Counted(voc.inner), Counted(voc.last)
    words = sorted({"".join(random.Random(k).choice("bcdfglmnprstvaeiou") for _ in range(20)) for k in range(200)})
    for word, ids in voc.traverse(words):
        assert list(ids) == library.encode(word, add_special_tokens=False).ids
    assert looked < 5 * sum(map(len, words))
