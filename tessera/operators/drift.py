"""Drift between two snapshots of an architecture: findings by kind, their order, counts and policy.

A snapshot is a set of tables: files, edges, symbols and the number of duplicate
groups. Keys don't hold positions, so moved lines are no drift. Both sides of
a table meet in one grouping by key, whose bits say on which side a key stands;
nulls are equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import graphs

NUL = "\u0000"
# The kinds of findings with their severities (a type change is graver where code begins to depend at run time).
SEVERITY = {
    "new-cycle": "error",
    "resolved-cycle": "info",
    "hotspot-jump": "warning",
    "hotspot-drop": "info",
    "unresolved-import": "error",
    "resolved-unresolved-import": "info",
    "public-api-addition": "info",
    "public-api-removal": "error",
    "duplicate-increase": "warning",
    "duplicate-decrease": "info",
    "graph-edge-added": "info",
    "graph-edge-removed": "info",
    "graph-edge-type-changed": "info",
}
JUMP, MOST = 20, 100


def _row(kind: Column, key: Column, severity: Column | None = None) -> list[Column]:
    grade = F.lit("info")
    for k, v in SEVERITY.items():
        if v != "info":
            grade = F.when(kind == k, v).otherwise(grade)
    return [kind.alias("kind"), (grade if severity is None else severity).alias("severity"), key.alias("key")]


def set_findings(base: DataFrame, head: DataFrame, added: str | None, removed: str) -> DataFrame:
    """(kind, severity, key) of keys on one side only; without ``added`` only what is gone."""
    side = lambda t, bit: t.select("key", F.lit(bit).alias("bit"))
    both = side(base, 1).unionByName(side(head, 2)).groupBy("key").agg(F.bit_or("bit").alias("bits"))
    kind = F.when(F.col("bits") == 2, F.lit(added)).when(F.col("bits") == 1, F.lit(removed))
    return both.select(*_row(kind, F.col("key"))).where("kind is not null")


def edge_findings(base: DataFrame, head: DataFrame, mode: str = "full") -> DataFrame:
    """Edges added, removed, or turned from type-only to run time or back; ``summary`` counts the first two by file, ``off`` gives none."""
    names = ["from_path", "raw", "to_path"]
    # bits: 1 type-only, 2 at run time; those of the head are shifted by two
    side = lambda t, shift: t.select(*names, F.when(F.coalesce("type_only", F.lit(False)), 1 << shift).otherwise(2 << shift).alias("bit"))
    both = side(base, 0).unionByName(side(head, 2)).groupBy(*names).agg(F.bit_or("bit").alias("bits")).where("(bits & 3) != shiftright(bits, 2)")
    rows = both.select(*names, F.expr("shiftright(bits, 2) & ~bits").alias("new"), F.expr("bits & 3 & ~shiftright(bits, 2)").alias("gone"))
    if mode == "off":
        rows = rows.limit(0)
    key = F.concat_ws(NUL, *names)
    flipped = rows.where("new > 0 and gone > 0").select(*_row(F.lit("graph-edge-type-changed"), key, F.when(F.col("new") == 1, "info").otherwise("warning")))
    plain = rows.where("new = 0 or gone = 0")
    held = lambda c: F.array_compact(F.array(F.when(F.col(c).bitwiseAND(1) > 0, True), F.when(F.col(c).bitwiseAND(2) > 0, False)))
    part = lambda c, kind: plain.select("from_path", F.lit(kind).alias("kind"), F.explode(held(c)).alias("t"), key.alias("k"))
    flat = part("new", "graph-edge-added").unionByName(part("gone", "graph-edge-removed"))
    if mode == "summary":
        return flipped.unionByName(flat.select("kind", "from_path").distinct().select(*_row(F.col("kind"), F.concat_ws(":", "kind", "from_path"))))
    return flipped.unionByName(flat.select(*_row(F.col("kind"), F.concat_ws(NUL, "k", F.when(F.col("t"), "type").otherwise("value")))))


def hotspot_findings(files: DataFrame, base: DataFrame, head: DataFrame, jump: int = JUMP) -> DataFrame:
    """(kind, severity, key, before, after): scores that rose or fell by ``jump`` or more; an absent file scores 0."""
    a = graphs.hotspots(files, base, None).select("file", F.col("score").alias("before"))
    b = graphs.hotspots(files, head, None).select("file", F.col("score").alias("after"))
    both = a.join(b, "file", "full_outer").na.fill(0)
    delta = F.col("after") - F.col("before")
    kind = F.when(delta >= jump, "hotspot-jump").when(-delta >= jump, "hotspot-drop")
    return both.where((F.abs(delta) >= jump) & (delta != 0)).select(*_row(kind, F.col("file")), "before", "after")


def cycle_keys(edges: DataFrame) -> DataFrame:
    """(key) of each cycle: its sorted files."""
    labels = graphs.cycle_labels(edges)
    return labels.groupBy("component").agg(F.array_join(F.sort_array(F.collect_list("node")), NUL).alias("key")).select("key")


def duplicate_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """One finding if the number of duplicate groups (a table with one row, ``groups``) differs."""
    rows = before.select(F.lit(0).alias("x"), F.col("groups").alias("a")).join(after.select(F.lit(0).alias("x"), F.col("groups").alias("b")), "x")
    kind = F.when(F.col("b") > F.col("a"), "duplicate-increase").when(F.col("b") < F.col("a"), "duplicate-decrease")
    return rows.select(*_row(kind, F.lit("duplicates:groups"))).where("kind is not null")


def findings(files: DataFrame, base: dict[str, DataFrame], head: dict[str, DataFrame], jump: int = JUMP, edges: str = "full", api: str = "all") -> DataFrame:
    """(kind, severity, key) of all findings between snapshots with ``edges``, ``symbols`` and, if known, ``duplicates``.

    ``edges``: full, summary or off; ``api``: all, removals or off.
    """
    held = lambda t, n: t if hasattr(t, "_tessera_path") else materialise(t.select("from_path", "raw", "to_path", "to_type", "type_only"), n)
    a, b = held(base["edges"], "drift-base"), held(head["edges"], "drift-head")
    out = edge_findings(a, b, edges)
    out = out.unionByName(hotspot_findings(files, a, b, jump).select("kind", "severity", "key"))
    out = out.unionByName(set_findings(cycle_keys(a), cycle_keys(b), "new-cycle", "resolved-cycle"))
    name = lambda t: t.where("to_type = 'external'").select(F.concat_ws(NUL, "from_path", "to_path").alias("key"))
    out = out.unionByName(set_findings(name(a), name(b), "unresolved-import", "resolved-unresolved-import"))
    if api != "off":
        public = lambda t: t.where("exported").select(F.concat(F.col("file"), F.lit("#"), F.col("name"), F.lit(":"), F.col("kind")).alias("key"))
        out = out.unionByName(set_findings(public(base["symbols"]), public(head["symbols"]), "public-api-addition" if api == "all" else None, "public-api-removal"))
    if "duplicates" in base and "duplicates" in head:
        out = out.unionByName(duplicate_findings(base["duplicates"], head["duplicates"]))
    return out


def rank() -> Column:
    return F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)


def report(found: DataFrame, limit: int | None = MOST) -> DataFrame:
    """The gravest findings first, then by kind and key."""
    rows = found.orderBy(rank(), "kind", "key")
    return rows if limit is None else rows.limit(limit)


def summary(found: DataFrame, fail_on: Sequence[str] = ()) -> DataFrame:
    """(kind, severity, findings, failed): counts of all findings, whatever a report shows; ``failed`` for the kinds of ``fail_on``."""
    return found.groupBy("kind", "severity").agg(F.count("*").alias("findings")).withColumn("failed", F.col("kind").isin(list(fail_on)) if fail_on else F.lit(False))
