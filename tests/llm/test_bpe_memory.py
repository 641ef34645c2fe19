import random

from quillon.llm import bpe
from test_bpe import PATH


def test_words_are_still_known_after_many_others():
    """A worker's documents have far more distinct words than a slice of them."""
    voc, learned, rng = bpe.Vocabulary(PATH), [], random.Random(3)
    own = voc.learn
    voc.learn = lambda words: learned.append(set(words)) or own(learned[-1])
    text = "some words with thndonsting and ofanatwhed <|endoftext|>"
    before = list(voc.encode([text]))
    for _ in range(6):
        list(voc.encode([" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(25_000))]))
    learned.clear()
    assert list(voc.encode([text])) == before
    assert not set().union(*learned)
    assert len(voc.young) + len(voc.old) <= 2 * bpe.MEMORY + 25_000
