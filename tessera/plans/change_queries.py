"""Registered queries of change impact, drift, links, file classes and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import textual
from ..operators import drift, graphs, impact, reports, review
from ..sources import adapters as ad
from ..storage import materialise

from .queries import _SCC, _SIDES, _TESTS, _URLS, END, HOT, START, _sides, _sql_files, _urls, query

# --- impact -----------------------------------------------------------------------------------

#: Changed symbols, the references to them, and changed files, over the driver's tables.
_CHG = f"""chg AS (SELECT id, file, name, kind, exported, kind = 'interface' AS type_only, line_span % 5 = 0 AS signature_changed, line_span AS start FROM symbols WHERE file IN ('{START}', '{END}'))"""
_REFS = """refs AS (SELECT to_id AS def_id, 'src/s' || (substr(from_id, 2)::BIGINT % 60 + 1) || '.ts' AS file,
  CASE label WHEN 'implements' THEN 'namespaceMember' WHEN 'extends' THEN 'importAlias' ELSE 'directRef' END AS reason, CASE seq % 3 WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS resolution FROM symbol_edges WHERE from_id <> to_id)"""
_FILES = """changes AS (SELECT 'src/s' || s_suppkey || '.ts' AS path, CASE WHEN s_suppkey % 10 = 8 THEN 'src/s' || (s_suppkey + 1) || '.ts' END AS old_path,
  CASE s_suppkey % 10 WHEN 7 THEN 'deleted' WHEN 8 THEN 'renamed' ELSE 'modified' END AS kind, s_suppkey % 10 = 6 AS whole FROM supplier WHERE s_suppkey BETWEEN 16 AND 48 AND s_suppkey % 10 BETWEEN 6 AND 8)"""
_LINK = "link AS (SELECT from_path, to_path, bool_and(coalesce(type_only, false)) AS type_only FROM file_edges WHERE to_type = 'file' AND from_path <> to_path GROUP BY 1, 2)"
_FAN = "fan AS (SELECT to_path AS file, count(*) AS fan_in FROM file_edges WHERE to_type = 'file' GROUP BY 1)"
_ALL = ad.with_ctes("file_edges", "symbols", "symbol_edges")
_PASSED = r"s[0-9]*5\.ts$"  # files that count as tests and are passed over


def _chg(spark, d):
    s = ad.symbols(spark, d).where(F.col("file").isin(START, END))
    return s.select("id", "file", "name", "kind", "exported", (F.col("kind") == "interface").alias("type_only"), (F.col("line_span") % 5 == 0).alias("signature_changed"), F.col("line_span").alias("start"))


def _refs(spark, d):
    e = ad.symbol_edges(spark, d).where("from_id != to_id")
    file = F.concat(F.lit("src/s"), (F.substring("from_id", 2, 20).cast("long") % 60 + 1).cast("string"), F.lit(".ts"))
    reason = F.when(F.col("label") == "implements", "namespaceMember").when(F.col("label") == "extends", "importAlias").otherwise("directRef")
    return e.select(F.col("to_id").alias("def_id"), file.alias("file"), reason.alias("reason"), F.when(F.col("seq") % 3 == 1, "medium").when(F.col("seq") % 3 == 2, "low").alias("resolution"))


def _changes(spark, d):
    k = F.col("s_suppkey")
    path = lambda n: F.concat(F.lit("src/s"), n.cast("string"), F.lit(".ts"))
    s = ad.table(spark, d, "supplier").where(k.between(16, 48) & (k % 10).between(6, 8))
    return s.select(path(k).alias("path"), F.when(k % 10 == 8, path(k + 1)).alias("old_path"), F.when(k % 10 == 7, "deleted").when(k % 10 == 8, "renamed").otherwise("modified").alias("kind"), (k % 10 == 6).alias("whole"))


def _passed():
    return F.col("file").rlike(_PASSED)


_W = "(CASE {r} WHEN 'directRef' THEN 1.0 WHEN 'namespaceMember' THEN 0.8 WHEN 'importAlias' THEN 0.6 ELSE 0.4 END)"
_SURE = "(CASE {r} WHEN 'directRef' THEN 1.0 WHEN 'namespaceMember' THEN 0.9 WHEN 'importAlias' THEN 0.85 ELSE 0.6 END) * (CASE {c} WHEN 'medium' THEN 0.85 WHEN 'low' THEN 0.6 ELSE 1.0 END)"


@query("impact_severity", f"""WITH r AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'directRef' WHEN 'N' THEN 'namespaceMember' ELSE 'transitive' END AS reason, CASE l_suppkey % 3 WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS c FROM lineitem),
q AS (SELECT *, {_SURE.format(r="reason", c="c")} * pow(0.9, l_linenumber) AS sure FROM r), s AS (SELECT *, {_W.format(r="reason")} * (CASE WHEN l_linestatus = 'F' THEN 1.2 ELSE 1.0 END) * (1 + least(log10(l_quantity + 1), 1.0))
 * (CASE WHEN l_tax > 0.04 THEN 1.2 ELSE 1.0 END) * (CASE WHEN l_discount > 0.05 THEN 0.7 ELSE 1.0 END) * pow(0.8, l_linenumber) * sure AS s FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(s / (1 + s), 9) AS severity, round(sure, 9) AS confidence FROM s""")
def impact_severity(spark, d):
    li = ad.table(spark, d, "lineitem")
    reason = F.when(F.col("l_returnflag") == "A", "directRef").when(F.col("l_returnflag") == "N", "namespaceMember").otherwise("transitive")
    resolution = F.when(F.col("l_suppkey") % 3 == 1, "medium").when(F.col("l_suppkey") % 3 == 2, "low")
    rows = li.select("*", impact.confidence(reason, resolution, F.col("l_linenumber")).alias("sure"))
    s = impact.severity(reason, F.col("l_linestatus") == "F", F.col("l_quantity"), F.col("l_tax") > 0.04, F.col("l_discount") > 0.05, F.col("l_linenumber"), F.col("sure"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(s, 9).alias("severity"), F.round("sure", 9).alias("confidence"))


def _levels(start: str, depth: int, out: str) -> str:
    """Relaxation over importers, a level at a time, from the table ``start`` (file, depth, severity, confidence); passed-over files take no part."""
    sql, front = f"k0 AS (SELECT file, min(depth) AS depth, max(severity) AS severity, max(confidence) AS confidence FROM {start} GROUP BY 1)", "SELECT file FROM k0 WHERE depth = 0"
    for d in range(depth):
        sql += f""",
f{d} AS ({front}),
s{d} AS (SELECT from_path AS file, max(0.3 * (CASE WHEN type_only THEN 0.6 ELSE 1.0 END) * pow(0.7, {d + 1})) AS s, max(greatest(0.2, least(1.0, k.confidence * (CASE WHEN type_only THEN 0.75 ELSE 0.85 END) * pow(0.95, {d})))) AS c
  FROM k{d} k JOIN f{d} USING (file) JOIN link ON to_path = k.file {out} GROUP BY 1),
k{d + 1} AS (SELECT file, least(k.depth, CASE WHEN x.s IS NOT NULL THEN {d + 1} END) AS depth, greatest(k.severity, x.s) AS severity, greatest(k.confidence, x.c) AS confidence FROM k{d} k FULL OUTER JOIN s{d} x USING (file))"""
        front = f"SELECT file FROM s{d} UNION SELECT file FROM {start} WHERE depth = {d + 1}" if d == 0 else ""
    return sql


@query("impact_transitive", f"""{ad.with_ctes("file_edges")}, {_LINK}, start AS (SELECT unnest(['{START}', '{END}']) AS file, 0 AS depth, 1.0::DOUBLE AS severity, unnest([1.0, 0.3])::DOUBLE AS confidence),
{_levels("start", 2, "")} SELECT file, depth, round(severity, 9) AS severity, round(confidence, 9) AS confidence, file IN (SELECT file FROM start) AS seed FROM k2""")
def impact_transitive(spark, d):
    start = spark.createDataFrame([(START, 0, 1.0, 1.0), (END, 0, 1.0, 0.3)], "file string, depth int, severity double, confidence double")
    return impact.propagate(ad.file_edges(spark, d), start, 2).select("file", "depth", F.round("severity", 9).alias("severity"), F.round("confidence", 9).alias("confidence"), "seed")


_DIRECT = f"""{_FAN}, graded AS (SELECT r.file, r.reason, r.resolution, c.name, {_SURE.format(r="r.reason", c="r.resolution")} AS sure,
  {_W.format(r="r.reason")} * (CASE WHEN c.exported THEN 1.2 ELSE 1.0 END) * (CASE WHEN fan_in > 0 THEN 1 + least(log10(fan_in + 1), 1.0) ELSE 1.0 END) * (CASE WHEN r.file = c.file THEN 1.2 ELSE 1.0 END) * (CASE WHEN c.type_only THEN 0.7 ELSE 1.0 END) AS w
  FROM refs r JOIN chg c ON c.id = r.def_id LEFT JOIN fan f ON f.file = r.file WHERE NOT regexp_matches(r.file, '{_PASSED}')),
direct AS (SELECT file, max(w * sure / (1 + w * sure)) AS severity, arg_max(sure, (w * sure / (1 + w * sure), sure)) AS confidence, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, string_agg(DISTINCT name, ',' ORDER BY name) AS symbols,
  CASE max(CASE resolution WHEN 'low' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'low' WHEN 1 THEN 'medium' END AS resolution FROM graded GROUP BY 1)"""


@query("impact_direct", f"{_ALL}, {_CHG}, {_REFS}, {_DIRECT} SELECT file, round(severity, 9) AS severity, round(confidence, 9) AS confidence, reasons, symbols, resolution FROM direct")
def impact_direct(spark, d):
    found = impact.direct_references(_chg(spark, d), _refs(spark, d), ad.file_edges(spark, d), _passed())
    return found.withColumns({c: F.round(c, 9) for c in ("severity", "confidence")})


_SEEDS = f"""seeded AS (SELECT from_path AS file, max((severity, 0.5, reason)) AS b FROM (
    SELECT DISTINCT from_path, 0.6 AS severity, 'transitive' AS reason FROM link WHERE to_path IN (SELECT path FROM changes WHERE kind IN ('deleted', 'renamed') UNION SELECT old_path FROM changes WHERE kind = 'renamed')
    UNION ALL SELECT DISTINCT from_path, 0.45, 'fileLevelChange' FROM link WHERE to_path IN (SELECT path FROM changes WHERE kind IN ('added', 'modified') AND whole) AND to_path NOT IN (SELECT file FROM {{known}})
  ) WHERE from_path NOT IN (SELECT file FROM {{known}}) AND NOT regexp_matches(from_path, '{_PASSED}') GROUP BY 1)"""


@query("impact_seeds", f"{ad.with_ctes("file_edges")}, {_LINK}, {_FILES}, none AS (SELECT '{START}' AS file), {_SEEDS.format(known='none')} SELECT file, b[1]::DOUBLE AS severity, 0.5::DOUBLE AS confidence, b[3] AS reason FROM seeded")
def impact_seeds(spark, d):
    return impact.seeds(ad.file_edges(spark, d), _changes(spark, d), spark.createDataFrame([(START,)], "file string"), _passed())


_REPORT = f"""{_ALL}, {_CHG}, {_REFS}, {_LINK}, {_FILES}, {_DIRECT}, {_SEEDS.format(known='direct')},
start AS (SELECT file, 0 AS depth, severity, confidence FROM direct UNION ALL SELECT file, 1, b[1]::DOUBLE, 0.5 FROM seeded), {_levels("start", 2, f"WHERE NOT regexp_matches(from_path, '{_PASSED}')")},
items AS (SELECT file, depth, k.severity, k.confidence, coalesce(x.reasons, s.b[3], 'transitive') AS reasons, coalesce(x.symbols, '') AS symbols FROM k2 k LEFT JOIN direct x USING (file) LEFT JOIN seeded s USING (file))"""


def _items(spark, d):
    return impact.analysed(ad.file_edges(spark, d), _chg(spark, d), _refs(spark, d), _changes(spark, d), 2, _passed())


@query("impact_report", f"{_REPORT} SELECT file, depth, round(severity, 9) AS severity, round(confidence, 9) AS confidence, reasons, symbols FROM items")
def impact_report(spark, d):
    found = _items(spark, d)
    return found.orderBy(*impact.ordered(found)).withColumns({c: F.round(c, 9) for c in ("severity", "confidence")})


@query("impact_compact", f"{_REPORT}, book AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS file_id FROM items) SELECT file_id, depth, round(severity, 9) AS severity, reasons FROM items JOIN book USING (file)")
def impact_compact(spark, d):
    _, rows = impact.compact(_items(spark, d))
    return rows.select("file_id", "depth", F.round("severity", 9).alias("severity"), "reasons")


@query("impact_stream", f"""{_REPORT}, r AS (SELECT file, depth, round(severity, 9) AS severity, round(confidence, 9) AS confidence FROM items)
SELECT 'partial' AS phase, file, severity, row_number() OVER (ORDER BY depth, file) - 1 AS place FROM r UNION ALL SELECT 'final', file, severity, row_number() OVER (ORDER BY severity DESC, confidence DESC, file) - 1 FROM r""")
def impact_stream(spark, d):
    rows = impact.streamed(_items(spark, d).withColumns({c: F.round(c, 9) for c in ("severity", "confidence")}))
    part = lambda phase: graphs.numbered(rows.where(F.col("phase") == phase), ["o"], "place").select("phase", "file", "severity", "place")
    return part("partial").unionByName(part("final"))


@query("dependency_stats", f"{ad.with_ctes('file_edges')} SELECT to_path AS file, count(*) AS fan_in, count(DISTINCT from_path) AS importers FROM file_edges WHERE to_type = 'file' GROUP BY 1")
def dependency_stats(spark, d):
    return impact.fan_in(ad.file_edges(spark, d))


@query("symbol_budget", f"""{_ALL}, {_CHG}, {_FAN} SELECT id, file, name, kind FROM chg LEFT JOIN fan USING (file)
ORDER BY NOT signature_changed, NOT exported, coalesce(fan_in, 0) = 0, CASE kind WHEN 'function' THEN 0 WHEN 'variable' THEN 2 ELSE 1 END, -coalesce(fan_in, 0), file, start, id LIMIT {impact.MAX_SYMBOLS}""")
def symbol_budget(spark, d):
    return impact.budgeted(_chg(spark, d), ad.file_edges(spark, d)).select("id", "file", "name", "kind")


@query("impact_cycles", ad.with_ctes("file_edges", recursive=True) + _SCC + f""", c AS (SELECT component, string_agg(node, ',' ORDER BY node) AS files, count(*) AS size, bool_or(node IN ('{START}', '{END}')) AS touches_changed, bool_or(node = 'src/s9.ts') AS touches_impacted FROM scc GROUP BY 1)
SELECT files, size, touches_changed, touches_impacted, CASE WHEN touches_changed THEN 'high' ELSE 'medium' END AS severity FROM c WHERE touches_changed OR touches_impacted""")
def impact_cycles(spark, d):
    file = lambda *names: spark.createDataFrame([(n,) for n in names], "file string")
    return impact.impact_cycles(ad.file_edges(spark, d), file(START, END), file("src/s9.ts")).drop("priority")


@query("weakest_edges", ad.with_ctes("file_edges", "symbols", "symbol_edges", recursive=True) + _SCC + f""", {_LINK.replace("link AS", "links AS", 1)}, coupling AS (SELECT a.file AS from_path, b.file AS to_path, count(*) AS n FROM symbol_edges JOIN symbols a ON a.id = from_id JOIN symbols b ON b.id = to_id WHERE a.file <> b.file GROUP BY 1, 2),
r AS (SELECT a.component, l.from_path, l.to_path, coalesce(n, 0) AS coupling, type_only FROM links l JOIN scc a ON a.node = l.from_path JOIN scc b ON b.node = l.to_path AND b.component = a.component LEFT JOIN coupling c ON c.from_path = l.from_path AND c.to_path = l.to_path)
SELECT component, from_path, to_path, coupling, type_only FROM r QUALIFY row_number() OVER (PARTITION BY component ORDER BY coupling, NOT type_only, from_path, to_path) = 1""")
def weakest_edges(spark, d):
    s = ad.steps(spark, d)
    return graphs.weakest_edges(ad.file_edges(spark, d, s), reports.symbol_coupling(ad.symbols(spark, d), ad.symbol_edges(spark, d, s)))


@query("surface_tops", f"""{ad.with_ctes("files", "file_edges")}, h AS ({HOT.format(e='file_edges')}), t AS (SELECT 'fan_in' AS side, file, fan_in AS n FROM h UNION ALL SELECT 'fan_out', file, fan_out FROM h)
SELECT side, row_number() OVER w AS place, file FROM t WINDOW w AS (PARTITION BY side ORDER BY n DESC, file) QUALIFY row_number() OVER w <= 10""")
def surface_tops(spark, d):
    return impact.surface_tops(graphs.hotspots(ad.files(spark, d), ad.file_edges(spark, d), None))


@query("reexport_chains", f"""{_ALL}, {_CHG}, rx AS (SELECT DISTINCT to_path AS source, from_path AS exporter, CASE resolved WHEN 'precise' THEN 'reexport' ELSE 'exportStar' END AS form, CASE WHEN resolved = 'precise' THEN 'red plate' END AS name FROM file_edges WHERE to_type = 'file' AND seq % 23 = 0),
x AS (SELECT id, name, [file] AS p FROM chg WHERE exported),
p1 AS (SELECT DISTINCT id, x.name, list_append(p, exporter) AS p FROM x JOIN rx ON source = p[-1] WHERE (form <> 'reexport' OR rx.name = x.name) AND NOT list_contains(p, exporter)),
p2 AS (SELECT DISTINCT id, x.name, list_append(p, exporter) AS p FROM p1 x JOIN rx ON source = p[-1] WHERE (form <> 'reexport' OR rx.name = x.name) AND NOT list_contains(p, exporter))
SELECT id AS symbol, array_to_string(p, '>') AS path FROM (FROM p1 UNION ALL FROM p2)""")
def reexport_chains(spark, d):
    e = ad.file_edges(spark, d).where("to_type = 'file' and seq % 23 = 0")
    precise = F.col("resolved") == "precise"
    rx = e.select(F.col("to_path").alias("source"), F.col("from_path").alias("exporter"), F.when(precise, "reexport").otherwise("exportStar").alias("form"), F.when(precise, "red plate").alias("name"))
    return impact.reexport_chains(rx, _chg(spark, d), 2).select("symbol", F.array_join("path", ">").alias("path"))


# --- reviews ----------------------------------------------------------------------------------


@query("review_report", f"""{_ALL}, {ad.CTES["files"]}, {_LINK}, changed AS (SELECT unnest(['{START}', '{END}', 'src/nowhere.ts']) AS file), one AS (SELECT DISTINCT from_path AS f FROM link WHERE to_path IN (SELECT file FROM changed)),
two AS (SELECT DISTINCT from_path AS f FROM link WHERE to_path IN (SELECT f FROM one)), n AS (SELECT (SELECT count(*) FROM changed) AS changed_files, (SELECT count(*) FROM changed WHERE file NOT IN (SELECT path FROM files)) AS missing,
(SELECT count(*) FROM symbols WHERE file IN (SELECT file FROM changed)) AS changed_symbols, (SELECT count(*) FROM symbols WHERE exported AND file IN (SELECT file FROM changed)) AS exported_symbols,
(SELECT count(*) FROM (SELECT f FROM one UNION SELECT f FROM two) WHERE f NOT IN (SELECT file FROM changed)) AS impacted_files,
(SELECT least(100, count(*)) FROM (SELECT file AS f FROM changed UNION SELECT f FROM one UNION SELECT f FROM two) WHERE regexp_matches(f, '{_TESTS}')) AS tests),
r AS (SELECT *, 0 AS failures, least(100, CASE WHEN exported_symbols > 0 THEN 60 ELSE 20 END + CASE WHEN changed_symbols >= 20 THEN 20 ELSE 0 END + CASE WHEN changed_files >= 10 THEN 20 ELSE 0 END + CASE WHEN missing > 0 THEN 30 ELSE 0 END) AS risk FROM n)
SELECT *, CASE WHEN risk >= 70 THEN 'high' WHEN risk >= 40 THEN 'medium' ELSE 'low' END AS level FROM r""")
def review_report(spark, d):
    changed = spark.createDataFrame([(START,), (END,), ("src/nowhere.ts",)], "file string")
    return review.review(ad.files(spark, d), ad.file_edges(spark, d), ad.symbols(spark, d), changed, lambda p: textual.is_test_file(p, [_TESTS]))


@query("review_tasks", """WITH o AS (SELECT o_orderkey, o_custkey % 2 AS exported, o_orderkey % 3 AS tests, o_custkey % 13 AS files, o_orderkey % 25 AS symbols, o_custkey % 5 // 4 AS failures, o_orderkey % 7 // 6 AS missing FROM orders)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN true THEN 'review-summary:medium' END, CASE WHEN exported > 0 THEN 'api-compat:high' END, CASE WHEN tests = 0 THEN 'tests-missing:medium' END, CASE WHEN files >= 10 OR symbols >= 20 THEN 'high-change-volume:high' END,
CASE WHEN failures > 0 THEN 'analysis-degraded:high' END, CASE WHEN missing > 0 THEN 'missing-input-files:high' END], lambda x: x IS NOT NULL), ',') AS tasks FROM o""")
def review_tasks(spark, d):
    o, c = ad.table(spark, d, "orders"), F.col
    whole = lambda x: F.floor(x).cast("int")
    found = review.tasks(c("o_custkey") % 2, c("o_orderkey") % 3, c("o_custkey") % 13, c("o_orderkey") % 25, whole(c("o_custkey") % 5 / 4), whole(c("o_orderkey") % 7 / 6))
    return o.select("o_orderkey", F.array_join(F.transform(found, lambda t: F.concat_ws(":", t["id"], t["priority"])), ",").alias("tasks"))


@query("unused_exports", f"{ad.with_ctes('symbols', 'symbol_edges')}, u AS (SELECT to_id FROM symbol_edges WHERE from_id <> to_id AND seq % 40 = 0) SELECT id, name, file FROM symbols WHERE exported AND id NOT IN (SELECT to_id FROM u) AND file NOT IN ('{START}', 'src/s4.ts')")
def unused_exports(spark, d):
    file = lambda n: spark.createDataFrame([(n,)], "file string")
    return reports.unused_exports(ad.symbols(spark, d), ad.symbol_edges(spark, d).where("seq % 40 = 0"), file(START), file("src/s4.ts"))


# --- drift ------------------------------------------------------------------------------------

_SEV = "CASE WHEN kind IN ('new-cycle', 'unresolved-import', 'public-api-removal') THEN 'error' WHEN kind IN ('hotspot-jump', 'duplicate-increase') THEN 'warning' ELSE 'info' END"
_NUL = "chr(0)"
_EDGE_DRIFT = f"""ea AS (SELECT DISTINCT from_path, raw, to_path, coalesce(type_only, false) AS t FROM base), eb AS (SELECT DISTINCT from_path, raw, to_path, coalesce(type_only, false) AS t FROM head),
ed AS (SELECT from_path, raw, to_path, t, 'a' AS side FROM (SELECT * FROM ea EXCEPT SELECT * FROM eb) UNION ALL SELECT from_path, raw, to_path, t, 'b' FROM (SELECT * FROM eb EXCEPT SELECT * FROM ea)),
eg AS (SELECT from_path, raw, to_path, bool_or(t) FILTER (side = 'a') AS gone, bool_or(t) FILTER (side = 'b') AS new, from_path || {_NUL} || raw || {_NUL} || to_path AS k FROM ed GROUP BY ALL),
edges AS (SELECT 'graph-edge-type-changed' AS kind, CASE WHEN new THEN 'info' ELSE 'warning' END AS severity, k AS key FROM eg WHERE gone IS NOT NULL AND new IS NOT NULL
  UNION ALL SELECT CASE side WHEN 'a' THEN 'graph-edge-removed' ELSE 'graph-edge-added' END, 'info', k || {_NUL} || CASE WHEN t THEN 'type' ELSE 'value' END FROM ed JOIN eg USING (from_path, raw, to_path) WHERE gone IS NULL OR new IS NULL)"""
_HOT_DRIFT = f"""ha AS ({HOT.format(e="base")}), hb AS ({HOT.format(e="head")}), hot AS (SELECT file, ha.score AS before, hb.score AS after FROM ha JOIN hb USING (file)),
hots AS (SELECT CASE WHEN after > before THEN 'hotspot-jump' ELSE 'hotspot-drop' END AS kind, file AS key, before, after FROM hot WHERE abs(after - before) >= {{jump}} AND after <> before)"""


def _scc(t: str, p: str) -> str:
    """Cycle keys of the edges ``t``, as tables with the prefix ``p``."""
    return f"""{p}l AS (SELECT DISTINCT from_path AS u, to_path AS v FROM {t} WHERE to_type = 'file'), {p}r(u, v) AS (SELECT u, v FROM {p}l UNION SELECT r.u, l.v FROM {p}r r JOIN {p}l l ON l.u = r.v),
{p}s AS (SELECT a.u AS node, max(greatest(a.u, a.v)) AS component FROM {p}r a JOIN {p}r b ON a.u = b.v AND a.v = b.u GROUP BY 1), {p}k AS (SELECT string_agg(node, {_NUL} ORDER BY node) AS key FROM {p}s GROUP BY component)"""


def _only(a: str, b: str, added: str, removed: str) -> str:
    return f"SELECT '{added}' AS kind, key FROM ({b} EXCEPT {a}) UNION ALL SELECT '{removed}', key FROM ({a} EXCEPT {b})"


_UNRES = f"SELECT from_path || {_NUL} || to_path AS key FROM {{t}} WHERE to_type = 'external'"
_API = "SELECT file || '#' || {name} || ':' || kind AS key FROM symbols WHERE exported"
_LATER = "CASE WHEN line_span % 9 = 0 THEN name || '2' ELSE name END"
_DRIFT = f"""{ad.with_ctes("files", "file_edges", "symbols", recursive=True)}{_SIDES}, {_EDGE_DRIFT}, {_HOT_DRIFT.format(jump=5)}, {_scc("base", "xa")}, {_scc("head", "xb")},
sets AS ({_only("SELECT key FROM xak", "SELECT key FROM xbk", "new-cycle", "resolved-cycle")} UNION ALL {_only(_UNRES.format(t="base"), _UNRES.format(t="head"), "unresolved-import", "resolved-unresolved-import")}
  UNION ALL {_only(_API.format(name="name"), _API.format(name=_LATER), "public-api-addition", "public-api-removal")}),
dup AS (SELECT (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)) AS a, (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY source, text HAVING count(*) > 1)) AS b),
found AS (SELECT * FROM edges UNION ALL SELECT kind, {_SEV}, key FROM (SELECT kind, key FROM hots UNION ALL FROM sets UNION ALL SELECT CASE WHEN b > a THEN 'duplicate-increase' ELSE 'duplicate-decrease' END, 'duplicates:groups' FROM dup WHERE a <> b))"""


def _findings(spark, d):
    s = ad.symbols(spark, d)
    later = s.withColumn("name", F.when(F.col("line_span") % 9 == 0, F.concat("name", F.lit("2"))).otherwise(F.col("name")))
    # texts meet as digests, and both groupings start from the finer one
    texts = materialise(ad.table(spark, d, "documents").groupBy("source", F.sha2("text", 256).alias("text")).agg(F.count("*").alias("n")), "drift-texts")
    groups = lambda *k: texts.groupBy(*k).agg(F.sum("n").alias("n")).where("n > 1").agg(F.count("*").alias("groups"))
    base = materialise(ad.file_edges(spark, d).select("from_path", "raw", "to_path", "to_type", "type_only", "confidence"), "drift-base")
    head = ad.moved_edges(spark, d, base)
    return drift.findings(ad.files(spark, d), {"edges": base, "symbols": s, "duplicates": groups("text")}, {"edges": head, "symbols": later, "duplicates": groups("source", "text")}, jump=5)


@query("drift_edges", f"{ad.with_ctes('file_edges')}{_SIDES}, {_EDGE_DRIFT} SELECT kind, severity, replace(key, {_NUL}, '|') AS key FROM edges")
def drift_edges(spark, d):
    return drift.edge_findings(*_sides(spark, d)).withColumn("key", F.translate("key", drift.NUL, "|"))


@query("drift_edge_summary", f"{ad.with_ctes('file_edges')}{_SIDES}, {_EDGE_DRIFT} SELECT DISTINCT kind, severity, kind || ':' || string_split(key, {_NUL})[1] AS key FROM edges WHERE kind <> 'graph-edge-type-changed'")
def drift_edge_summary(spark, d):
    return drift.edge_findings(*_sides(spark, d), mode="summary").where("kind != 'graph-edge-type-changed'")


@query("drift_hotspots", f"{ad.with_ctes('files', 'file_edges')}{_SIDES}, {_HOT_DRIFT.format(jump=5)} SELECT kind, {_SEV} AS severity, key, before, after FROM hots")
def drift_hotspots(spark, d):
    return drift.hotspot_findings(ad.files(spark, d), *_sides(spark, d), jump=5)


@query("drift", f"{_DRIFT} SELECT kind, severity, replace(key, {_NUL}, '|') AS key FROM (SELECT * FROM found ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, kind, key LIMIT {drift.MOST})")
def drift_report(spark, d):
    return drift.report(_findings(spark, d)).withColumn("key", F.translate("key", drift.NUL, "|"))


@query("drift_summary", f"{_DRIFT} SELECT kind, severity, count(*) AS findings, kind IN ('new-cycle', 'hotspot-jump') AS failed FROM found GROUP BY 1, 2")
def drift_summary(spark, d):
    return drift.summary(_findings(spark, d), ["new-cycle", "hotspot-jump"])


# --- classes and links ------------------------------------------------------------------------


@query("path_classes", f"""WITH {_URLS}, p AS (SELECT page_id, lower(path) AS p FROM urls) SELECT page_id, CASE WHEN p = 'readme.md' OR p LIKE 'docs/%' OR regexp_matches(p, '\\.(md|mdx|rst|adoc|txt)$') THEN 'docs' WHEN p = 'dockerfile' OR p LIKE '.github/%' OR regexp_matches(p, '\\.(json|yaml|yml|toml|ini|env)$') THEN 'config' ELSE 'code' END AS surface,
regexp_matches(p, '(^|/)__tests__(/|$)|(^|/)tests?(/|$)|(^|/)specs?(/|$)|\\.(test|spec)\\.[^./]+$|(^|/)[^/]*[-_.](test|spec)\\.[^./]+$|[0-9]+7(/|\\.html)?$') AS is_test FROM p""")
def path_classes(spark, d):
    return _urls(spark, d).select("page_id", textual.surface(F.col("path")).alias("surface"), textual.is_test_file(F.col("path"), [r"[0-9]+7(/|\.html)?$"]).alias("is_test"))


#: Paths and texts that show every role, dealt over the orders.
_ROLE_PATHS = ["db/schema.sql", "db/migrations/a.sql", "db/20240101_x.sql", "V2__y.sql", "seeds/s.sql", "test/fixtures/f.sql", "backup/all.sql", "functions/g.sql", "reports/r.sql", "a/other.sql", "app/db/migrate/z.sql"]
_ROLE_TEXTS = ["SELECT 1", "CREATE TABLE a (x int);\nCREATE  TABLE b (y int);", "ALTER TABLE a ADD z int", "COPY a FROM stdin", "-- nothing", "CREATE TABLE one (x int)"]


@query("sql_role", f"""WITH o AS (SELECT o_orderkey, ([{", ".join(f"'{p}'" for p in _ROLE_PATHS)}])[o_orderkey % {len(_ROLE_PATHS)} + 1] AS p, ([{", ".join("'" + t.replace(chr(10), "' || chr(10) || '") + "'" for t in _ROLE_TEXTS)}])[o_custkey % {len(_ROLE_TEXTS)} + 1] AS t FROM orders),
m AS (SELECT *, lower(p) AS l, lower(string_split(p, '/')[-1]) AS b, string_split(lower(p), '/') AS s FROM o), g AS (SELECT *, list_has_any(s, ['migration', 'migrations']) OR contains(l, '/db/migrate/') OR regexp_matches(b, '^([0-9]{{3,}}|v[0-9]+__)[\\w.-]*\\.sql$') AS mig FROM m)
SELECT o_orderkey, CASE WHEN b IN ('schema.sql', 'structure.sql', 'init.sql', 'database.sql') OR (len(regexp_extract_all(lower(t), 'create\\s+table')) >= 2 AND NOT mig) THEN 'schema_snapshot' WHEN list_has_any(s, ['dump', 'dumps', 'backup', 'backups']) OR regexp_matches(lower(t), '\\bcopy\\s+\\w+\\s+from\\b') THEN 'dump'
WHEN list_has_any(s, ['seed', 'seeds']) THEN 'seed' WHEN list_has_any(s, ['fixture', 'fixtures', 'testdata']) THEN 'fixture' WHEN mig OR regexp_matches(lower(t), '\\balter\\s+table\\b') THEN 'migration' WHEN list_has_any(s, ['routine', 'routines', 'functions', 'procedures']) THEN 'routine'
WHEN list_has_any(s, ['query', 'queries', 'reports', 'analytics']) OR regexp_matches(lower(t), '\\b(select|with|update|delete|insert\\s+into)\\b') THEN 'query' ELSE 'unknown' END AS role FROM g""")
def sql_role(spark, d):
    pick = lambda values, key: F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))
    return ad.table(spark, d, "orders").select("o_orderkey", textual.sql_role(pick(_ROLE_PATHS, "o_orderkey"), pick(_ROLE_TEXTS, "o_custkey")).alias("role"))


@query("html_references", """WITH t AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<((script|link|a|img|source|video|audio|iframe|track)\\b([^>"'']|"[^"]*"|''[^'']*'')*)>', 1)) AS m FROM pages),
g AS (SELECT page_id, lower(regexp_extract(m, '^\\w+')) AS tag, unnest(regexp_extract_all(m, '(?i)[^\\w:.-]((href|srcset|src)\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+))', 1)) AS a FROM t),
v AS (SELECT page_id, tag, lower(regexp_extract(a, '^\\w+')) AS attribute, regexp_replace(regexp_extract(a, '=\\s*(.*)$', 1, 's'), '^["'']|["'']$', '', 'g') AS value FROM g),
k AS (SELECT * FROM v WHERE (tag IN ('script', 'img', 'source', 'video', 'audio', 'iframe', 'track') AND attribute = 'src') OR (tag IN ('link', 'a') AND attribute = 'href') OR (tag IN ('img', 'source') AND attribute = 'srcset'))
SELECT * FROM (SELECT page_id, tag, attribute, unnest(CASE WHEN attribute = 'srcset' THEN list_transform(string_split(value, ','), lambda x: regexp_extract(x, '^\\s*(\\S*)', 1)) ELSE [trim(value)] END) AS target FROM k) WHERE target <> ''""")
def html_references(spark, d):
    return reports.html_references(ad.table(spark, d, "pages"))


#: Links of the pages as if they stood in docs/p<id>/index.md: every kind of state occurs.
_KNOWN = "known AS (SELECT 'docs/p' || page_id || '/index.md' AS path FROM pages UNION SELECT DISTINCT regexp_replace(regexp_extract(html, 'href=\"/?([^\"#?:]*)', 1), '^/', '') FROM pages WHERE page_id % 2 = 0)"


@query("broken_links", f"""WITH {_KNOWN}, l AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS t FROM pages UNION ALL SELECT page_id, unnest(['#top', '#none', '../p' || (page_id + 1) || '/index.md#top', '../../../../out.md', './/../p' || page_id || '/./index.md', NULL]) FROM pages),
p AS (SELECT page_id, t AS destination, 'docs/p' || page_id || '/' AS base, regexp_replace(t, '[?#].*$', '') AS bare, nullif(regexp_extract(t, '#(.*)$', 1), '') AS fragment FROM l),
q AS (SELECT *, CASE WHEN bare = '' THEN base || 'index.md' WHEN starts_with(bare, '/') THEN bare ELSE base || bare END AS place FROM p),
r AS (SELECT *, array_to_string(list_reduce(string_split(place, '/'), lambda acc, x: CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN acc[:-2] ELSE list_append(acc, x) END, []::VARCHAR[]), '/') AS resolved FROM q)
SELECT page_id, destination, resolved, CASE WHEN destination IS NULL THEN 'missing_reference' WHEN regexp_matches(destination, '^[a-zA-Z][a-zA-Z0-9+.-]*:|^//') THEN 'external' WHEN regexp_matches(resolved, '^\\.\\.(/|$)') THEN 'outside_root' WHEN resolved NOT IN (SELECT path FROM known WHERE path IS NOT NULL) THEN 'missing_file'
WHEN fragment IS NOT NULL AND resolved LIKE 'docs/p%/index.md' AND fragment <> 'top' THEN 'missing_fragment' ELSE 'ok' END AS status FROM r""")
def broken_links(spark, d):
    pages = ad.table(spark, d, "pages")
    own = F.concat(F.lit("docs/p"), F.col("page_id").cast("string"), F.lit("/index.md"))
    near = F.concat(F.lit("../p"), (F.col("page_id") + 1).cast("string"), F.lit("/index.md#top"))
    more = pages.select("page_id", F.explode(F.array(F.lit("#top"), F.lit("#none"), near, F.lit("../../../../out.md"), F.concat(F.lit(".//../p"), F.col("page_id").cast("string"), F.lit("/./index.md")), F.lit(None).cast("string"))).alias("target"))
    found = reports.links(pages).unionByName(more).select("page_id", own.alias("file"), F.col("target").alias("destination"))
    known = pages.select(own.alias("path")).union(pages.where("page_id % 2 = 0").select(F.regexp_replace(F.regexp_extract("html", 'href="/?([^"#?:]*)', 1), "^/", "")))
    anchors = pages.select(own.alias("path"), F.lit("top").alias("anchor"))
    return reports.broken_links(found, known, anchors).select("page_id", "destination", "resolved", "status")



