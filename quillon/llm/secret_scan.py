"""Secret scans over an incremental blob ledger.

Every historical version of every path is addressed by the SHA-256 of its content. The ledger remembers which rule versions have
been run over which blob and what they found; a run scans only pairs of blob and rule version that it has not seen, each blob
once however many paths hold it, and joins findings back to all paths.

Only hashes are grouped. The text of one path per new blob is picked by a join on blob and path, so that thousands of copies of a blob
spread over the tasks, and texts are shuffled once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices, written

# The base rules. A match that is too short is dropped after matching, as it also uses up its text.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the length can be asked for in the pattern
# Further rules, after the base ones in order.
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")
_FORGE = re.compile(r"gh[opsur]_[A-Za-z0-9]{36,}")
_WEB = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")


def _assign(text: str) -> Iterator[tuple[int, int]]:
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield m.span()


def _access(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20)


def _plain(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


#: Kind -> (version, finder), in the order in which kinds are listed. A changed finder takes a new version.
RULES: dict[str, tuple[int, Callable[[str], Iterator[tuple[int, int]]]]] = {
    "assign": (1, _assign),
    "access": (1, _access),
    "hex": (1, _plain(_HEX)),
    "private": (1, _plain(_PRIVATE)),
    "forge": (1, _plain(_FORGE)),
    "web": (1, _plain(_WEB)),
}
BASE = ("assign", "access", "hex")
LEDGER = "blob_id binary, scanned array<string>, findings array<struct<kind:string,start:int,end:int>>"


def rule_ids(rules: dict = RULES) -> list[str]:
    """Kind and version of each rule, as the ledger keeps them."""
    return [f"{kind}@{version}" for kind, (version, _) in rules.items()]


def find(text: str, rules: dict, wanted: set[str]) -> list[dict]:
    """Spans of the wanted rule versions by start, then kind as listed; code points, end exclusive."""
    found = [(start, k, kind, end) for k, (kind, (version, finder)) in enumerate(rules.items()) if f"{kind}@{version}" in wanted for start, end in finder(text)]
    return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(found)]


def blob_id(content: Column) -> Column:
    """Content address."""
    return F.unhex(F.sha2(content, 256))


def scan_blobs(blobs: DataFrame, rules: dict = RULES) -> DataFrame:
    """Ledger rows of blobs (blob_id, todo array<string>, content)."""
    out = pa.schema([("blob_id", pa.binary()), ("scanned", pa.list_(pa.string())), ("findings", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            todo = batch.column("todo").to_pylist()
            found = [find(text.as_py(), rules, set(todo[i])) for i, text in enumerate(batch.column("content"))]
            yield pa.RecordBatch.from_arrays([batch.column("blob_id").cast(pa.binary()), pa.array(todo, out.field(1).type), pa.array(found, out.field(2).type)], schema=out)

    return blobs.select("blob_id", "todo", "content").mapInArrow(scan, LEDGER)


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: dict = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) for versions (path, content) and the ledger of earlier runs.

    findings has one row for each row of versions: path, blob_id, findings (by start, then kind as listed). A null content counts as
    empty; null and repeated paths are kept as they are; an empty table gives no rows. The returned ledger holds the earlier
    rows and those of this run, and is already stored in the shared folder.
    """
    ids = F.array(*[F.lit(x) for x in rule_ids(rules)])
    content = F.coalesce("content", F.lit(""))
    held = versions.select("path", F.xxhash64("path").alias("handle"), blob_id(content).alias("blob_id"), content.alias("content"))
    fresh = held.groupBy("blob_id").agg(F.min("handle").alias("handle"))
    if ledger is None:
        fresh = fresh.withColumn("todo", ids)
    else:
        seen = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        todo = F.array_except(ids, F.coalesce("seen", F.array().cast("array<string>")))
        fresh = fresh.join(seen, "blob_id", "left").select("blob_id", "handle", todo.alias("todo")).where(F.size("todo") > 0)
    picked = held.select("handle", "blob_id", "content").join(fresh.hint("shuffle_hash"), ["blob_id", "handle"])
    # rows that repeat a path and its content are picked together; one of their equal results stays
    new = written(scan_blobs(picked, rules).dropDuplicates(["blob_id"]), "secret-ledger")
    if ledger is None:
        known, after = new.select("blob_id", "findings"), new
    else:
        after = written(ledger.select("blob_id", "scanned", "findings").unionByName(new), "secret-ledger")
        order = F.create_map(*[x for k, kind in enumerate(rules) for x in (F.lit(kind), F.lit(k))])
        current = after.select("blob_id", F.explode("findings").alias("f"), "scanned").where(F.exists("scanned", lambda s: F.arrays_overlap(F.array(s), ids) & (F.substring_index(s, "@", 1) == F.col("f.kind"))))
        listed = F.sort_array(F.collect_set(F.struct("f.start", order[F.col("f.kind")].alias("k"), "f.kind", "f.end")))
        known = written(current.groupBy("blob_id").agg(listed.alias("l")).select("blob_id", F.transform("l", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("findings")), "secret-known")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    back = held.select("path", "blob_id").join(known.where(F.size("findings") > 0), "blob_id", "left")
    return back.select("path", "blob_id", F.coalesce("findings", none).alias("findings")), after


def spans_text(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def redact(text: str, findings: list, mark: str = "[secret]") -> str:
    """The text with each stretch of overlapping findings replaced by a mark."""
    out, at = [], 0
    for f in sorted(findings, key=lambda f: f["start"]):
        if f["start"] >= at:
            out += [text[at:f["start"]], mark]
        at = max(at, f["end"])
    return "".join([*out, text[at:]])
