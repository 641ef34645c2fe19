import random

import pytest

from quillon.llm import align
from test_align import A, B, Libraries, brute


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


def odd_spaces(count):
    """Texts of few words with white space of all kinds, and strings that look like white space or marks, between them."""
    rng = random.Random(11)
    parts = [" ", " ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "​", "　", "a", "the", "word", "Ab", "'s", "'", "12", ".", ",", "é", "語", "́", "\x00", "<s>", "▁"]
    return ["".join(rng.choices(parts, [3] * 29 + [3, 0.1], k=rng.randrange(1, 24))) for _ in range(count)]


@pytest.mark.parametrize("apart", [True, False])
def test_windows_met_before_give_the_same_in_every_text(libraries, apart, monkeypatch):
    """One block for all texts, so that windows met in one text are used in others; by either way of cutting."""
    va, vb = align.vocabularies(A, B)
    assert vb.apart
    monkeypatch.setattr(vb, "apart", apart)
    block, texts = align.Block(va, vb), odd_spaces(4000)
    want = brute(texts, libraries)
    for text, (n_a, n_b, n_groups, n_links, *_, groups) in zip(texts, want, strict=True):
        got = block.add(text, 1)
        assert (got[:5] if got else (0, 0, 0, 0, "")) == (n_a, n_b, n_groups, n_links, groups), text


def test_known_windows_are_not_tokenised_again(monkeypatch):
    va, vb = align.vocabularies(A, B)
    block, seen = align.Block(va, vb), []
    for v in (va, vb):
        monkeypatch.setattr(v, "encode", lambda text, own=v.encode: seen.append(text) or own(text))
    first = block.add("several words, and several more words.", 1)
    assert seen == ["several words, and more words."] * 2
    again = block.add("more words. and several words,", 1)
    assert len(seen) == 2 and first and again


def test_models_that_look_beyond_anchors_are_told_apart(tmp_path):
    """A model whose pieces go on over a blank, one that is no BPE, one that drops blanks."""
    from sentencepiece import sentencepiece_model_pb2

    with open(B, "rb") as f:
        plain = f.read()

    def changed(name, change):
        model = sentencepiece_model_pb2.ModelProto.FromString(plain)
        change(model)
        (tmp_path / name).write_bytes(model.SerializeToString())
        return align.Pieces(str(tmp_path / name)).apart

    assert changed("same", lambda m: None)
    assert not changed("over", lambda m: setattr(m.pieces[-1], "piece", "of▁the"))
    assert not changed("kind", lambda m: setattr(m.trainer_spec, "model_type", m.trainer_spec.UNIGRAM))
    assert not changed("drop", lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True))
