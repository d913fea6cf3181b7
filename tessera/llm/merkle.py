"""Merkle fixity audits of WARC replicas.

A manifest has a row for each record: ``offset``, ``length``, ``digest``. Leaves
are ranges of ``RANGE`` bytes of the archive, hashed over the digests of the
records that begin there, in the order of their offsets; each further level
hashes up to ``FANOUT`` neighbours. Two replicas are compared from the root:
only children of differing nodes are looked at, and records are compared in
differing leaves only.

Groups are bounded by construction: a leaf by the records that fit in a range, a
node by the fan-out. Levels grow with the logarithm of the archive.

Defined cases: null addresses and bodies are empty, null ids come first; equal
manifests differ nowhere; a record without counterpart at
its offset is ``missing`` (from the replica) or ``extra``; several rows at one
offset count as one record that joins their distinct digests; null digests
compare as empty; empty manifests have no root, and everything in the other is
missing or extra. Extra columns are ignored by :func:`archive` and :func:`audit`;
:func:`report` keeps those of the primary, but replica_digest and status give
way to the new ones. Records of any length count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise

#: The capture date of records that carry none.
DATE = "2024-01-01T00:00:00Z"
RANGE = 1 << 16
FANOUT = 16


def record(name: Column, url: Column, body: Column, date: str = DATE) -> Column:
    """A WARC/1.0 response record as text; its record id is a UUID made of the page's name and address."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    h = F.md5(F.concat(F.coalesce(name.cast("string"), F.lit("")), F.lit("\n"), url))
    part = lambda a, n: F.substring(h, a, n)
    uuid = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", copy: Column | None = None) -> DataFrame:
    """(id, copies, offset, length, digest): the archive's layout, records by id, then digest.

    With ``copy``, the body as a replica holds it at the same place, the hash of
    that record comes along as copy_digest. Equal records of one id are folded
    into one row first, so that no key can fill a task; ranges of the sort are
    numbered by themselves and shifted by the bytes before them, of which the
    driver sees one number a range.
    """
    text = record(F.col(id_col), F.col(url_col), F.col(body_col))
    more = [] if copy is None else [F.sha2(record(F.col(id_col), F.col(url_col), copy), 256).alias("copy_digest")]
    rows = pages.select(id_col, F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("length"), *more)
    told = ["copy_digest"] * len(more)
    folded = rows.groupBy(id_col, "digest", "length", *told).agg(F.count("*").alias("copies"))
    placed = materialise(folded.repartitionByRange(id_col, "digest", *told).withColumn("part", F.spark_partition_id()), "archive")
    size = F.col("length") * F.col("copies")
    before, starts = 0, []
    for r in sorted(placed.groupBy("part").agg(F.sum(size).alias("n")).collect(), key=lambda r: r.part):
        starts.append((r.part, before))
        before += r.n
    base = pages.sparkSession.createDataFrame(starts, "part int, base long")
    w = Window.partitionBy("part").orderBy(F.col(id_col).asc_nulls_first(), "digest", *told).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(size).over(w), F.lit(0))
    return placed.withColumn("inside", inside).join(F.broadcast(base), "part").select(id_col, "copies", (F.col("base") + F.col("inside")).alias("offset"), "length", "digest", *told)


def levels(manifest: DataFrame) -> list[DataFrame]:
    """Tables (node, hash) from the leaves to the root."""
    one = manifest.groupBy("offset").agg(F.array_join(F.sort_array(F.collect_set(F.coalesce("digest", F.lit("")))), "+").alias("digest"))
    rows = one.select(F.floor(F.col("offset") / RANGE).cast("long").alias("node"), F.struct("offset", "digest").alias("x"))
    out = [_hashed(rows, lambda x: F.concat_ws(":", x["offset"].cast("string"), x["digest"]))]
    top = out[0].agg(F.max("node")).first()[0] or 0
    while top:
        below = out[-1]
        out.append(_hashed(below.select(F.floor(F.col("node") / FANOUT).cast("long").alias("node"), F.struct(F.col("node").alias("n"), "hash").alias("x")), lambda x: F.concat_ws(":", x["n"].cast("string"), x["hash"])))
        top //= FANOUT
    return out


def _hashed(rows: DataFrame, text) -> DataFrame:
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("x")), text), "\n")
    return materialise(rows.groupBy("node").agg(F.sha2(listed, 256).alias("hash")), "merkle")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(offset, digest, replica_digest, status) of the records that differ: corrupt, missing or extra."""
    a, b = levels(primary), levels(replica)
    while len(a) < len(b):
        a.append(_raised(a[-1]))
    while len(b) < len(a):
        b.append(_raised(b[-1]))
    wrong: DataFrame | None = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if wrong is not None:
            inside = lambda t, w=wrong: t.join(w.select((F.col("node")).alias("parent")), F.floor(t["node"] / FANOUT) == F.col("parent"), "left_semi")
            x, y = inside(x), inside(y)
        pair = x.select("node", F.col("hash").alias("p")).join(y.select("node", F.col("hash").alias("q")), "node", "full_outer")
        wrong = materialise(pair.where(~F.col("p").eqNullSafe(F.col("q"))).select("node"), "merkle-wrong")
    here = lambda t, name: t.join(wrong, F.floor(t["offset"] / RANGE) == wrong["node"], "left_semi").groupBy("offset").agg(F.array_join(F.sort_array(F.collect_set(F.coalesce("digest", F.lit("")))), "+").alias(name))
    both = here(primary, "digest").join(here(replica, "replica_digest"), "offset", "full_outer")
    status = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
    return both.where(~F.col("digest").eqNullSafe(F.col("replica_digest"))).withColumn("status", status)


def _raised(table: DataFrame) -> DataFrame:
    """One more level over a tree that is lower than its counterpart."""
    return _hashed(table.select(F.floor(F.col("node") / FANOUT).cast("long").alias("node"), F.struct(F.col("node").alias("n"), "hash").alias("x")), lambda x: F.concat_ws(":", x["n"].cast("string"), x["hash"]))


def report(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """``primary`` with replica_digest and status (ok, corrupt or missing)."""
    found = audit(primary, replica).where("status != 'extra'").select(F.col("offset").alias("_at"), "replica_digest", "status")
    kept = [c for c in primary.columns if c not in ("replica_digest", "status")]
    rows = primary.select(*kept).join(found, F.col("offset") == F.col("_at"), "left")
    return rows.select(*kept, F.when(F.col("status").isNull(), F.col("digest")).otherwise(F.col("replica_digest")).alias("replica_digest"), F.coalesce("status", F.lit("ok")).alias("status"))
