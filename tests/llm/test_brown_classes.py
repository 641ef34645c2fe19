import math
import random
from collections import Counter

import numpy as np

from quillon.llm import brown


def test_words_outside_the_core_get_the_class_of_their_neighbours(spark, monkeypatch):
    """Two kinds of words alternate; endings say nothing of the kind."""
    rng = random.Random(2)
    frequent = [[f"{kind}{k}" for k in range(768)] for kind in "ab"]
    seldom = [[f"{rng.randrange(10**9)}xyz" for _ in range(150)] for _ in "ab"]
    rows = []
    for k in range(1500):
        own = [rng.choice(frequent[i % 2]) for i in range(60)]
        rows.append((k, " ".join(own)))
    for k in range(150):
        text = []
        for _ in range(6):
            text += [rng.choice(frequent[1]), seldom[0][k], rng.choice(frequent[1]), rng.choice(frequent[0]), seldom[1][k], rng.choice(frequent[0])]
        rows.append((9000 + k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (brown.TOP, 1600):
        top = brown.top_words
        monkeypatch.setattr(brown, "top_words", lambda vocabulary, m=0, most=most, top=top: top(vocabulary, most))
        model, rare = brown.fit(docs)
        classes = {w.decode(): int(model.of[r]) for w, r in model.top.items()} | {r["word"]: r["class"] for r in rare.collect()}
        kinds = [{classes[w] for w in side} for side in seldom]
        assert not kinds[0] & kinds[1]
        monkeypatch.setattr(brown, "top_words", top)


def test_scores_are_those_of_the_classes_and_counts(spark, documents, monkeypatch):
    """The model's transitions and every score, recomputed text by text from the classes and counts, with few words among the top ones and with all."""
    rng = random.Random(7)
    more = [(1000 + k, " ".join(f"w{min(int(rng.expovariate(0.001)), 2999)}" for _ in range(80))) for k in range(250)]
    documents = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in documents.collect()]
    train = [own for i, own in rows if i is not None and i % 3]
    counts, top_words = Counter(w for own in train for w in own), brown.top_words
    for most in (2600, 40):
        monkeypatch.setattr(brown, "top_words", lambda vocabulary, m=0, most=most: top_words(vocabulary, most))
        model, rare = brown.fit(documents.where("doc_id % 3 <> 0"))
        assert (len(model.history) > 1) == (most > brown.CORE)
        classes = {w: int(model.of[r]) for w, r in model.top.items()} | {r["word"].encode(): r["class"] for r in rare.collect()}
        assert set(classes) == set(counts) and {r["word"].encode(): r["n"] for r in rare.collect()} == {w: n for w, n in counts.items() if w not in model.top}
        end = int(model.of[brown.TOP + brown.END])

        def path(own, classes=classes, end=end, model=model):
            return [end, *[classes.get(w, int(model.of[brown.TOP + brown.ending(w)])) for w in own], end]

        joint = np.zeros((brown.CLASSES, brown.CLASSES))
        for own in train:
            np.add.at(joint, (path(own)[:-1], path(own)[1:]), 1.0)
        of_class = [sum(counts[w] for w in counts if classes[w] == c) + (len(train) if c == end else 0) for c in range(brown.CLASSES)]
        kinds = [sum(classes[w] == c for w in counts) + (c == end) for c in range(brown.CLASSES)]
        share = (np.array(of_class) + 1.0) / (sum(of_class) + brown.CLASSES)
        assert np.allclose(model.steps, np.log10((joint + share) / (joint.sum(1, keepdims=True) + 1.0)))
        want = []
        for i, own in rows:
            c = path(own)
            value = sum(math.log10(counts[w] + 1) for w in own) + math.log10(len(train) + 1)
            value += sum(model.steps[l, r] - math.log10(of_class[r] + kinds[r] + 1) for l, r in zip(c, c[1:]))
            want.append((str(i), value, 10 ** (-value / (len(own) + 1))))
        got = [(str(r["doc_id"]), r["score"], r["perplexity"]) for r in brown.score(documents, model, rare).collect()]
        for (i, x, p), (j, y, q) in zip(sorted(want), sorted(got), strict=True):
            assert i == j and math.isclose(x, y, rel_tol=1e-9) and math.isclose(p, q, rel_tol=1e-6)
