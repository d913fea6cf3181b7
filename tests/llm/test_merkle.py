import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle as m


def rec(name, url, body):
    body, url = body or "", url or ""
    h = hashlib.md5(f"{'' if name is None else name}\n{url}".encode()).hexdigest()
    uuid = f"{h[:8]}-{h[8:12]}-3{h[13:16]}-8{h[17:20]}-{h[20:]}"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{uuid}>\r\nWARC-Date: {m.DATE}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body.encode())}"
    return f"{head}\r\n\r\n{body}\r\n\r\n".encode()


def test_layout(spark):
    rows = [(3, "u", "é" * 50_000), (1, "v", None), (1, "v", None), (2, None, ""), (None, "n", "x"), (1, "v", "other"), (3, "u", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = [tuple(r) for r in m.archive(pages).orderBy("offset").collect()]
    folded = {}
    for i, u, b in rows:
        x = rec(i, u, b)
        key = (i is not None, i or 0, hashlib.sha256(x).hexdigest(), len(x), i)
        folded[key] = folded.get(key, 0) + 1
    want, at = [], 0
    for key in sorted(folded):
        want.append((key[4], folded[key], at, key[3], key[2]))
        at += key[3] * folded[key]
    assert got == want


def test_damaged_replica_is_found_by_its_own_hashes(spark):
    pages = spark.createDataFrame([(k, f"u{k}", f"body {k} " * 50) for k in range(200)] + [(3, "u3", "body 3 " * 50)], "page_id long, url string, html string").repartition(3)
    held = m.archive(pages, copy=F.when(F.col("page_id") == 120, F.replace("html", F.lit("o"), F.lit("0"))).otherwise(F.col("html")))
    told = {r.page_id: r for r in m.report(held, held.select("offset", F.col("copy_digest").alias("digest"))).collect()}
    assert [i for i, r in told.items() if r.status != "ok"] == [120]
    assert told[120].replica_digest == hashlib.sha256(rec(120, "u120", "b0dy 120 " * 50)).hexdigest() and told[3].copies == 2


@pytest.mark.parametrize("wide", [1, 500_000])
def test_audit_finds_exactly_the_differences(spark, wide):
    a = {k * 1000 * wide: f"d{k}" for k in range(300)}
    b = dict(a)
    del b[7000 * wide], b[299_000 * wide]
    b[5000 * wide] = "bad"
    b[123_000 * wide] = None
    b[400_000_000 * wide] = "new"
    want = {7000 * wide: "missing", 299_000 * wide: "missing", 5000 * wide: "corrupt", 123_000 * wide: "corrupt", 400_000_000 * wide: "extra"}
    to = lambda t: spark.createDataFrame([(o, 10, d) for o, d in t.items()], "offset long, length long, digest string").repartition(3)
    assert {r.offset: r.status for r in m.audit(to(a), to(b)).collect()} == want
    assert m.audit(to(a), to(a)).count() == 0
    told = {r.offset: (r.status, r.replica_digest) for r in m.report(to(a), to(b)).collect()}
    assert told == {o: (want.get(o, "ok"), b.get(o) if o not in want else (b[o] or "" if o in b else None)) for o in a}


def test_empty_manifests(spark):
    none = spark.createDataFrame([], "offset long, length long, digest string")
    one = spark.createDataFrame([(0, 1, "d"), (0, 1, "e"), (0, 1, "d")], "offset long, length long, digest string")
    assert m.audit(none, none).count() == 0
    assert [r.status for r in m.audit(one, none).collect()] == ["missing"]
    assert [r.status for r in m.audit(none, one).collect()] == ["extra"]
    assert m.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
