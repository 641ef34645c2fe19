"""A Merkle manifest of a table, with inclusion proofs made by partition from octopus multiproofs.

Every row is a leaf. The leaves of a language stand by doc_id and are hashed in runs of FAN until one node, the subroot, remains; subroots by language are hashed
likewise to the root. Proofs are not looked up leaf by leaf: each partition of neighbouring leaves works out which node coordinates it lacks for all its paths
together (the octopus: at each level the siblings of what it has or can derive, each once), fetches those in one join, derives the interior nodes that its leaves share,
and expands the single proofs locally.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import placed, written

#: Children of a node; levels that one task makes of a block of nodes; leaves of a partition, about.
FAN, LEVELS, LEAVES = 8, 4, 32_768
BLOCK = FAN**LEVELS


def h(text: str) -> str:
    """Lowercase hex sha256 of a text."""
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """Digest of a row's values, each by its length in bytes; null is a dash."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def document_leaf(text: Column | None = None) -> Column:
    """The leaf of a row of documents, or what it would be with another text."""
    return leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text") if text is None else text)


_NODES = "tree string, level int, idx long, n long, digest string"


def _raise(block: pa.Table) -> pa.Table:
    """The nodes of the next LEVELS levels above a block of at most BLOCK neighbours, as far as a level has more than one node."""
    rows = sorted(zip(block["idx"].to_pylist(), block["digest"].to_pylist(), strict=True))
    tree, level, n = (block[c][0].as_py() for c in ("tree", "level", "n"))
    out = []
    for k in range(1, LEVELS + 1):
        if n <= 1:
            break
        n, runs = -(-n // FAN), {}
        for idx, digest in rows:
            runs.setdefault(idx // FAN, []).append(digest)
        rows = [(idx, h("".join(run))) for idx, run in runs.items()]
        out += [(tree, level + k, idx, n, digest) for idx, digest in rows]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array([r[i] for r in out], kinds[i]) for i in range(5)], names=["tree", "level", "idx", "n", "digest"])


def _nodes(leaves: DataFrame, name: str) -> DataFrame:
    """(tree, level, idx, n, digest) of all nodes above and with the leaves (tree, pos, n, digest); n is how many nodes the tree has on that level."""
    level = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "n", "digest")
    found, done, most = level, 0, leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        above = level.groupBy("tree", F.expr(f"idx div {BLOCK}").alias("block")).applyInArrow(_raise, _NODES)
        above = written(above, name)
        found, done, most = found.unionByName(above), done + LEVELS, -(-most // BLOCK)
        level = above.where(F.col("level") == done)
    return found


@dataclass
class Manifest:
    """leaves: (doc_id, leaf, ..) with tree, part, pos, n, and the subroot's place (tree_pos) among all (trees); nodes: (top, tree, level, idx, digest)."""

    leaves: DataFrame
    nodes: DataFrame

    def root(self) -> DataFrame:
        """One row (root), none of an empty table."""
        return self.nodes.where("top AND n = 1").select(F.col("digest").alias("root"))


def manifest(rows: DataFrame) -> Manifest:
    """The trees over rows (doc_id, lang, leaf, ..); other columns are carried along.

    Within a language leaves stand by doc_id, null first, then by digest; languages stand by their bytes, null first. Repeated rows are leaves of their own;
    an empty table has no nodes.
    """
    named = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang"))
    held = written(rows.withColumn("tree", named).drop("lang"), "merkle-leaves")
    leaves = placed(held, "tree", ["doc_id", "leaf"], held.count() // LEAVES + 1, "merkle-placed")
    leaves = written(leaves, "merkle-places")
    low = _nodes(leaves.select("tree", "pos", "n", F.col("leaf").alias("digest")), "merkle-nodes")
    subroots = low.where("n = 1").select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    trees = placed(subroots, "tree", ["of"], subroots.count() // LEAVES + 1, "merkle-subroots")
    high = _nodes(trees.select("tree", "pos", "n", "digest"), "merkle-tops")
    places = trees.select(F.col("of").alias("tree"), F.col("pos").alias("tree_pos"), F.col("n").alias("trees"))
    return Manifest(leaves.join(places, "tree"), low.withColumn("top", F.lit(False)).unionByName(high.withColumn("top", F.lit(True))))


def _climb(known: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(level, nodes at hand, nodes that lack, nodes there are) from the leaves up: at hand is what the level below gives."""
    level = 0
    while n > 1:
        runs = np.unique(known // FAN)
        needed = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        yield level, known, np.setdiff1d(needed[needed < n], known, assume_unique=True), n
        known, n, level = runs, -(-n // FAN), level + 1


def _lacking(leaves: pa.Table) -> pa.Table:
    """Coordinates that a partition's leaves of one tree lack for all their proofs, each once."""
    part, tree = (leaves[c][0].as_py() for c in ("part", "tree"))
    place, n, trees = (leaves[c][0].as_py() for c in ("tree_pos", "n", "trees"))
    tops, levels, at = [], [], []
    for top, known, size in ((False, np.unique(leaves["pos"].to_numpy()), n), (True, np.array([place]), trees)):
        for level, _, lack, _ in _climb(known, size):
            tops += [top] * len(lack)
            levels += [level] * len(lack)
            at.append(lack)
    idx = np.concatenate(at) if at else np.zeros(0, np.int64)
    where = [pa.array([part] * len(idx), pa.int64()), pa.array([tree] * len(idx), pa.string()), pa.array(["" if t else tree for t in tops], pa.string())]
    return pa.table([*where, pa.array(tops, pa.bool_()), pa.array(levels, pa.int32()), pa.array(idx, pa.int64())], names=["part", "tree", "at", "top", "level", "idx"])


def _siblings(known: np.ndarray, n: int, fetched: dict[tuple[int, int], str], held: dict[int, str]) -> tuple[dict[int, str], str]:
    """(proof of each leaf within its tree, the tree's root) from the digests at hand (held) and those fetched by (level, idx)."""
    stages = []
    for level, at_hand, lack, size in _climb(known, n):
        here = held | {i: fetched[level, i] for i in lack.tolist()}
        stages.append((here, held.keys(), size))
        held = {r: h("".join([here[i] for i in range(r * FAN, min(r * FAN + FAN, size))])) for r in np.unique(at_hand // FAN).tolist()}
    proofs = dict.fromkeys(held, "")
    for here, at_hand, size in reversed(stages):
        below = {}
        for run, rest in proofs.items():
            members = range(run * FAN, min(run * FAN + FAN, size))
            for i in at_hand & members:
                below[i] = "".join([here[k] for k in members if k != i]) + rest
        proofs = below
    return proofs, next(iter(held.values()))


def proofs(made: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """wanted rows of made.leaves (all by default) with subroot, root and proof: the siblings' digests joined, level by level to the subroot and on to the root, left to right."""
    wanted = made.leaves if wanted is None else wanted
    places = wanted.select("part", "tree", "pos", "n", "tree_pos", "trees")
    lacking = places.groupBy("part", "tree").applyInArrow(_lacking, "part long, tree string, at string, top boolean, level int, idx long")
    nodes = made.nodes.select(F.col("tree").alias("at"), "top", "level", "idx", "digest")
    fetched = lacking.join(nodes, ["at", "top", "level", "idx"]).select("part", "tree", "top", "level", "idx", "digest")
    kinds = ", ".join(f"`{c}` {t}" for c, t in wanted.dtypes)

    def expand(leaves: pa.Table, found: pa.Table) -> pa.Table:
        if not leaves.num_rows:
            return pa.table({c: leaves[c] for c in leaves.column_names} | dict.fromkeys(("subroot", "root", "proof"), pa.array([], pa.string())))
        got = {False: {}, True: {}}
        for top, level, idx, digest in zip(*(found[c].to_pylist() for c in ("top", "level", "idx", "digest")), strict=True):
            got[top][level, idx] = digest
        place, n, trees = (leaves[c][0].as_py() for c in ("tree_pos", "n", "trees"))
        pos = leaves["pos"].to_pylist()
        own, subroot = _siblings(np.unique(np.array(pos)), n, got[False], dict(zip(pos, leaves["leaf"].to_pylist(), strict=True)))
        rest, root = _siblings(np.array([place]), trees, got[True], {place: subroot})
        size = leaves.num_rows
        more = {"subroot": [subroot] * size, "root": [root] * size, "proof": [own[p] + rest[place] for p in pos]}
        return pa.table({c: leaves[c] for c in leaves.column_names} | {c: pa.array(v, pa.string()) for c, v in more.items()})

    both = wanted.groupBy("part", "tree").cogroup(fetched.groupBy("part", "tree"))
    return both.applyInArrow(expand, f"{kinds}, subroot string, root string, proof string")


def fold(digest: str, proof: str, places: list[tuple[int, int]]) -> str:
    """The root that a leaf and its proof give; places: (position, size) in each tree on the way."""
    at = 0
    for pos, n in places:
        while n > 1:
            start = pos // FAN * FAN
            mid, end = at + 64 * (pos - start), at + 64 * (min(FAN, n - start) - 1)
            digest, at = h(proof[at:mid] + digest + proof[mid:end]), end
            pos, n = pos // FAN, -(-n // FAN)
    return digest


def verify(proved: DataFrame, column: str) -> DataFrame:
    """proved rows of proofs() with folded_root, from the leaf in a column and the proof alone, and verified (whether it is the root)."""
    fields = ["pos", "n", "tree_pos", "trees"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in proved.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch[column].to_pylist(), batch["proof"].to_pylist(), *(batch[c].to_pylist() for c in fields), strict=True)
            folded = [fold(leaf_, proof, [(p, n), (tp, tn)]) for leaf_, proof, p, n, tp, tn in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded, pa.string())], names=[*batch.schema.names, "folded_root"])

    return proved.mapInArrow(run, f"{kinds}, folded_root string").withColumn("verified", F.col("folded_root") == F.col("root"))
