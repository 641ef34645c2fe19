"""Language identification by hierarchical discrimination.

Features are hashed counts of one to three neighbouring letters over the whole text. Linear support vector machines, one for each two
families, predict the language family by vote; others, one for each two languages of a family, separate the languages within it.
Every machine is fitted in a task of its own on a bounded sample of labelled rows; prediction reads whole texts where they lie, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices

#: Language families by ISO code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es pt it ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indic": "hi ur bn pa gu mr ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he am mt",
    "sinitic": "zh yue wuu",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Features of a text are counted in so many buckets.
BUCKETS = 1 << 14
#: Code points of a text that are counted at a time.
PART = 1 << 20
#: Value for texts without a letter.
UNDETERMINED = "und"
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
#: Code points below 128 that are not letters count as a blank.
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def family(lang: str) -> str:
    """The family of a language code."""
    return _FAMILY.get(lang.split("-")[0].split("_")[0].lower(), lang)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Share of each bucket among the letter groups of a text; a very long one is counted a part at a time."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[32], np.where(c < 128, _FOLD[np.minimum(c, 127)], c), [32]]).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(c), PART):
        own = c[at : at + PART + 2]
        one, two, three = own * _A, own[1:] * _B, own[2:] * _C
        for h in (one ^ np.uint32(0x5BD1E995), one[:-1] + two, one[:-2] + two[:-1] + three):
            h = h[:PART]
            h = (h ^ (h >> np.uint32(15))) * _B
            counts += np.bincount(h >> np.uint32(18), minlength=BUCKETS)
    return counts / counts.sum()


def pack(x: np.ndarray) -> bytes:
    """The buckets of a text that hold anything, and their shares: six bytes each."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes() + x[at].astype(np.float32).tobytes()


def unpack(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, share, first) of packed texts: their entries one after the other, and where those of each text begin."""
    n = np.array([len(r) // 6 for r in rows])
    bucket = np.concatenate([np.frombuffer(r, np.uint16, k) for r, k in zip(rows, n, strict=True)]).astype(np.int32)
    share = np.concatenate([np.frombuffer(r, np.float32, k, 2 * k) for r, k in zip(rows, n, strict=True)])
    return bucket, share, np.cumsum(n) - n


def _fit(bucket: np.ndarray, value: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 300, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss, classes weighing alike; accelerated gradient steps on sparse rows."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(np.append(first, len(bucket))))
    w, v, b, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    norm = np.add.reduceat(value.astype(np.float64) ** 2, first)
    rate = 1.0 / (2.0 * float((share * (norm + 1.0)).sum()) + decay)
    for i in range(rounds):
        back = i / (i + 3.0)
        lw, lb = w + back * (w - v), b + back * (b - vb)
        slack = np.maximum(0.0, 1.0 - y * (np.add.reduceat(lw[bucket] * value, first) + lb)) * y * share
        v, vb = w, b
        w, b = lw - rate * (decay * lw - 2.0 * np.bincount(bucket, slack[row] * value, BUCKETS)), lb + rate * 2.0 * slack.sum()
    return w, float(b)


def _contests(langs: list[str]) -> list[tuple[str, str, str]]:
    """(kind, left, right) of every machine."""
    families = sorted({family(x) for x in langs})
    inner = [("lang", a, b) for a, b in combinations(sorted(langs), 2) if family(a) == family(b)]
    return [("family", a, b) for a, b in combinations(families, 2)] + inner


class Model:
    """The fitted machines: a column of weights each."""

    def __init__(self, langs: list[str], contests: list[tuple[str, str, str]], weights: np.ndarray, offsets: np.ndarray):
        self.langs, self.contests, self.weights, self.offsets = langs, contests, weights, offsets

    def _winner(self, kind: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The name with most votes (then the largest sum of margins), and its least probability in its contests."""
        if len(names) == 1:
            return names[0], 1.0
        votes = {n: [0, 0.0, 1.0] for n in names}
        for (k, a, b), m in zip(self.contests, margins, strict=True):
            if k == kind and a in votes and b in votes:
                p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, 4.0 * m))))
                for n, won, q in ((a, m >= 0, p), (b, m < 0, 1.0 - p)):
                    votes[n][0] += won
                    votes[n][1] += m if n == a else -m
                    votes[n][2] = min(votes[n][2], q)
        best = max(names, key=lambda n: (votes[n][0], votes[n][1], n))
        return best, votes[best][2]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score from 0 to 1)."""
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        margins = features(text) @ self.weights + self.offsets if self.contests else np.zeros(0)
        fam, p = self._winner("family", sorted({family(x) for x in self.langs}), margins)
        lang, q = self._winner("lang", [x for x in self.langs if family(x) == fam], margins)
        return lang, p * q


def fit(labelled: DataFrame, sample: int = 500) -> Model:
    """Fit on about `sample` rows of each language of labelled (key, text, lang); nulls and texts without a letter teach nothing.

    The sample takes the rows whose hash of key and text falls under the share that the language's row count asks for, so it is the same
    for equal input, and no language's rows meet in one task. Contests between families take two languages' worth of rows of a family at most. Rows go as
    sparse counts to the tasks that fit, never to the driver; weights come back, as many as there are machines times BUCKETS.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    contests = _contests(langs)
    if not contests:
        return Model(langs, [], np.zeros((BUCKETS, 0)), np.zeros(0))
    share = {x: min(1.0, sample / counts[x]) for x in langs}
    few = {x: share[x] * min(1.0, 2 / sum(family(y) == family(x) for y in langs)) for x in langs}
    limit = F.create_map(*[y for x in langs for y in (F.lit(x), F.lit(share[x]))])
    place = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) / (1 << 20)
    drawn = rows.withColumn("place", place).where(F.col("place") < limit[F.col("lang")]).select("text", "lang", "place")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple[int, float, bytes]] = []
            for text, lang, at in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "place")), strict=True):
                if has_letter(text):
                    x, own = pack(features(text)), {"family": family(lang), "lang": lang}
                    out += [(k, 1.0 if own[kind] == a else -1.0, x) for k, (kind, a, b) in enumerate(contests) if own[kind] in (a, b) and (kind == "lang" or at < few[lang])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.binary())], names=["contest", "y", "x"])

    def machine(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.assign(k=pdf["x"].map(hash_bytes)).sort_values(["y", "k"], kind="stable")
        bucket, value, first = unpack(order["x"].tolist())
        w, b = _fit(bucket, value * np.float32(SCALE), first, order["y"].to_numpy(np.float64))
        return pd.DataFrame({"contest": [int(pdf["contest"].iloc[0])], "w": [(w * SCALE).tobytes()], "b": [b]})

    fitted = drawn.mapInArrow(count, "contest int, y double, x binary").groupBy("contest").applyInPandas(machine, "contest int, w binary, b double").collect()
    weights, offsets = np.zeros((BUCKETS, len(contests))), np.zeros(len(contests))
    for r in fitted:
        weights[:, r["contest"]], offsets[r["contest"]] = np.frombuffer(bytes(r["w"]), np.float64), r["b"]
    return Model(langs, contests, weights, offsets)


#: Shares of buckets are small numbers; this brings texts to about unit length for fitting.
SCALE = 20.0


def hash_bytes(x: bytes) -> int:
    """An order for the rows of a sample that does not depend on how they arrived."""
    import xxhash

    return xxhash.xxh3_64_intdigest(x) >> 1


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, and any other columns asked for) with lang_pred and score: und and 0 for a null text or one without a letter.

    Every row keeps its place: repeated rows get the same answer, null ids pass through, an empty table gives no rows.
    """
    names = ["doc_id", "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(*names).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text has a letter; all columns stay.

    Rejection rests on the `und` rule alone: the machines name a language for every text with a letter. Where none could be learned these texts stay too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in columns:
            yield pa.array([m.predict(t.as_py())[0] != UNDETERMINED if m.langs else has_letter(t.as_py()) for t in texts], pa.bool_())
        pa.default_memory_pool().release_unused()  # the worker lives on

    return docs.where(F.arrow_udf(known, "boolean")("text"))
