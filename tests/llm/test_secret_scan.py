import hashlib
import re
import zlib

from pyspark.sql import functions as F

from quillon.llm import queries, secret_scan

KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(s for _, _, s in sorted(spans))


def versions(docs):
    return docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"), F.lit("x").alias("blob_id"), F.lit("y").alias("findings"))


def base(findings):
    return ",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in findings if f["kind"] in secret_scan.BASE)


def test_every_path_gets_the_findings_of_its_text(documents):
    found, ledger = secret_scan.scan_versions(versions(documents))
    got = sorted((str(r["path"]), base(r["findings"])) for r in found.collect())
    assert got == sorted((str(r["doc_id"]), brute(r["text"] or "")) for r in documents.collect())
    assert any(b for _, b in got)
    assert ledger.count() == len({r["text"] or "" for r in documents.collect()})


def test_a_second_run_scans_only_what_is_new(spark, documents):
    old = documents.where("doc_id < 20 OR doc_id = 309")
    _, ledger = secret_scan.scan_versions(versions(old))
    first = ledger.count()
    found, after = secret_scan.scan_versions(versions(documents), ledger)
    assert after.count() == len({r["text"] or "" for r in documents.collect()}) > first
    assert sorted((str(r["path"]), base(r["findings"])) for r in found.collect()) == sorted((str(r["doc_id"]), brute(r["text"] or "")) for r in documents.collect())
    again, same = secret_scan.scan_versions(versions(documents), after)
    assert same.count() == after.count() and again.count() == documents.count()
    changed = dict(secret_scan.RULES, hex=(2, lambda text: iter([(0, 1)] if text.startswith("long") else [])))
    found, later = secret_scan.scan_versions(versions(documents), after, changed)
    rows = {r["path"]: r["findings"] for r in found.where("path IN (306, 309)").collect()}
    assert [f["kind"] for f in rows[306]] == ["hex"] and "hex" not in [f["kind"] for f in rows[309]] and "assign" in [f["kind"] for f in rows[309]]
    assert {x for r in later.collect() for x in r["scanned"]} >= {"hex@1", "hex@2"}


def test_empty_table_and_redaction(no_documents):
    found, ledger = secret_scan.scan_versions(versions(no_documents))
    assert found.count() == 0 and ledger.count() == 0
    assert secret_scan.redact("a token=abcdef b", [{"start": 2, "end": 14}, {"start": 8, "end": 14}]) == "a [secret] b"


def test_the_query_scans_in_its_second_run_only_what_the_first_did_not(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op2_secret_scans(spark, folder).collect()}
    assert set(rows) == set(texts)
    early = {t for k, t in texts.items() if zlib.crc32(str(k).encode()) % 2 == 0}
    for k, text in texts.items():
        assert rows[k]["base_sha256"] == hashlib.sha256(brute(text).encode()).hexdigest()
        assert rows[k]["n_scanned"] == (0 if text in early else len(secret_scan.RULES))
    assert {r["n_scanned"] for r in rows.values()} == {0, len(secret_scan.RULES)}
