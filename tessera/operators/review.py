"""Change review: pairings, candidate tests, path enumeration, targets, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.textual import under
from ..storage import materialise
from . import duplicates, graphs, impact, reports
from .components import connected_components


def type_flips(base: DataFrame, head: DataFrame) -> DataFrame:
    """(from_path, to_path, was, now): removed and added edges of one identity that differ in type-only, paired one to one."""
    key = ["from_path", "to_path", "to_type"]
    side = lambda t, s: t.groupBy(*key, "type_only").agg(F.count("*").alias(s))
    both = side(base, "a").join(side(head, "b"), [*key, "type_only"], "full_outer").na.fill(0, ["a", "b"])
    gone, new = both.select(*key, F.col("type_only").alias("was"), (F.col("a") - F.col("b")).alias("gone")).where("gone > 0"), both.select(*key, F.col("type_only").alias("now"), (F.col("b") - F.col("a")).alias("new")).where("new > 0")
    met = gone.join(new, key).where("was != now")
    return met.select("from_path", "to_path", "was", "now", F.explode(F.sequence(F.lit(1), F.least("gone", "new").cast("int"))).alias("n")).drop("n")


def candidate_tests(edges: DataFrame, changed: DataFrame, is_test, limit: int = 100) -> DataFrame:
    """(test, confidence): high for changed tests and direct importers, medium at the second hop, low by shared stem."""
    inner = edges.where("to_type = 'file'").select("from_path", "to_path").distinct()
    first = inner.join(changed.select(F.col("file").alias("to_path")), "to_path", "left_semi").select(F.col("from_path").alias("test"))
    second = inner.join(first.select(F.col("test").alias("to_path")).distinct(), "to_path", "left_semi").select(F.col("from_path").alias("test"))
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"(^test_|_test|\.(test|spec))?\.[^.]*$", "")
    every = edges.select(F.col("from_path").alias("test")).union(edges.where("to_type = 'file'").select("to_path")).distinct()
    near = every.withColumn("s", stem(F.col("test"))).join(changed.select(stem(F.col("file")).alias("s")).distinct(), "s", "left_semi").select("test")
    ranked = changed.select(F.col("file").alias("test"), F.lit(0).alias("r")).unionByName(first.withColumn("r", F.lit(0))).unionByName(second.withColumn("r", F.lit(1))).unionByName(near.withColumn("r", F.lit(2)))
    best = ranked.where(is_test(F.col("test"))).groupBy("test").agg(F.min("r").alias("r"))
    name = F.when(F.col("r") == 0, "high").when(F.col("r") == 1, "medium").otherwise("low")
    return best.orderBy("r", "test").limit(limit).select("test", name.alias("confidence"))


def simple_paths(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(path array): walks of 1 to ``depth`` edges from ``starts`` (file) that repeat no node."""
    inner = edges.where("to_type = 'file'").select("from_path", "to_path").distinct()
    level = starts.select(F.array("file").alias("path"))
    out = None
    for _ in range(depth):
        level = level.join(inner, F.element_at("path", -1) == F.col("from_path")).where(~F.array_contains("path", F.col("to_path"))).select(F.concat("path", F.array("to_path")).alias("path"))
        out = level if out is None else out.unionByName(level)
    return out


def call_compatibility(args: Column, least: Column, most: Column) -> Column:
    """compatible, too_few, too_many, or unknown where a bound is null."""
    return F.when(args.isNull() | least.isNull(), "unknown").when(args < least, "too_few").when(args > F.coalesce(most, args), "too_many").otherwise("compatible")


def resolve_target(symbols: DataFrame, target: str) -> DataFrame:
    """(id, status): by id, then ``file::name``, then bare name; several matches are ambiguous."""
    place = F.when(F.col("id") == target, 0).when(F.concat_ws("::", "file", "name") == target, 1).when(F.col("name") == target, 2)
    found = materialise(symbols.select("id", place.alias("place")).where("place is not null"), "target")
    best = found.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").limit(1)
    return found.join(best, "place").select("id", F.when(F.col("n") > 1, "ambiguous").otherwise("found").alias("status"))


def surface_hash(symbols: DataFrame) -> DataFrame:
    """(file, hash) of each file's sorted exports."""
    names = F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "kind", "name"))), "\n")
    return symbols.where("exported").groupBy("file").agg(F.substring(F.sha1(names), 1, 16).alias("hash"))


def surface_area(files: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """(file, fan_in, fan_out, changed, impacted) of all files."""
    spread = impact.propagate(edges, changed, depth).where("not seed").select("file", F.lit(True).alias("impacted"))
    marks = changed.select("file", F.lit(True).alias("changed"))
    rows = graphs.hotspots(files, edges, None).join(marks, "file", "left").join(spread, "file", "left")
    return rows.select("file", "fan_in", "fan_out", F.coalesce("changed", F.lit(False)).alias("changed"), F.coalesce("impacted", F.lit(False)).alias("impacted"))


def impact_clusters(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """(component, members) of the touched files (file) over edges among them."""
    t = touched.select("file").distinct()
    inner = edges.where("to_type = 'file'").join(t, F.col("from_path") == F.col("file"), "left_semi").join(t, F.col("to_path") == F.col("file"), "left_semi")
    loops = t.select(F.col("file").alias("src"), F.col("file").alias("dst"))
    found = connected_components(inner.select(F.col("from_path").alias("src"), F.col("to_path").alias("dst")).unionByName(loops))
    return found.groupBy("component").agg(F.count("*").alias("members"))


def lines_saved(spans: DataFrame) -> DataFrame:
    """(group, saved): lines of a duplicate group's merged spans (group, file, start, end), less its longest span."""
    w = spans.withColumn("file", F.concat_ws("\u0000", F.col("group").cast("string"), "file")).select("file", "start", "end")
    merged = duplicates.merged_spans(w).withColumn("n", F.col("end") - F.col("start") + 1)
    group = F.substring_index("file", "\u0000", 1).alias("group")
    return merged.groupBy(group).agg((F.sum("n") - F.max("n")).alias("saved"))


def targeted_pairs(rows: DataFrame, targets: DataFrame, most: int = 200) -> DataFrame:
    """Scored pairs that touch a target (id): only buckets that hold one are paired."""
    return duplicates.scored_pairs(rows, most, pairs=duplicates.evidence(rows, most, targets))


def orient(files: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 10, most: int | None = 10) -> DataFrame:
    """(section, name, value): directories by files, the first ``limit`` hotspots by score, the first ``most`` cycles (all with None) by priority."""
    edges = materialise(edges.select("from_path", "to_path", "to_type"), "orient")
    a = reports.tree(files, depth).select(F.lit("directory").alias("section"), F.col("directory").alias("name"), F.col("files").alias("value"))
    b = graphs.hotspots(files, edges, limit).select(F.lit("hotspot").alias("section"), F.col("file").alias("name"), F.col("score").alias("value"))
    found = graphs.cycles(edges)
    c = (found if most is None else found.orderBy(F.desc("priority"), "files").limit(most)).select(F.lit("cycle").alias("section"), F.col("files").alias("name"), F.col("priority").alias("value"))
    return a.unionByName(b).unionByName(c)


def review(files: DataFrame, edges: DataFrame, symbols: DataFrame, changed: DataFrame, is_test, depth: int = 2, failures: int = 0) -> DataFrame:
    """One row: counts of changed, missing and impacted files, changed symbols and candidate tests, and the risk score.

    ``changed``: (file); files that aren't in ``files`` are missing. ``failures``: changed files that couldn't be read.
    """
    near = materialise(changed.select("file").distinct(), "review")
    told = {
        "changed_files": near.agg(F.count("*").alias("n")),
        "missing": near.join(files.select(F.col("path").alias("file")), "file", "left_anti").agg(F.count("*").alias("n")),
        "changed_symbols": symbols.join(near, "file", "left_semi").agg(F.count("*").alias("n")),
        "exported_symbols": symbols.join(near, "file", "left_semi").agg(F.count_if("exported").alias("n")),
        "impacted_files": impact.propagate(edges, near, depth).where("not seed").agg(F.count("*").alias("n")),
        "tests": candidate_tests(edges, near, is_test).agg(F.count("*").alias("n")),
    }
    rows = None
    for name, n in told.items():
        part = n.select(F.lit(name).alias("name"), "n")
        rows = part if rows is None else rows.unionByName(part)
    one = rows.agg(*[F.coalesce(F.max(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(name) for name in told])
    c = F.col
    risk = reports.review_risk(c("exported_symbols") > 0, c("changed_symbols"), c("changed_files"), c("missing"), F.lit(failures))
    level = F.when(c("risk") >= 70, "high").when(c("risk") >= 40, "medium").otherwise("low")
    return one.withColumn("failures", F.lit(failures)).withColumn("risk", risk).withColumn("level", level)


#: Review tasks with their priority, in order.
TASKS = ["review-summary", "api-compat", "tests-missing", "high-change-volume", "analysis-degraded", "missing-input-files"]
PRIORITY = ["medium", "high", "medium", "high", "high", "high"]


def tasks(exported: Column, tests: Column, files: Column, symbols: Column, failures: Column, missing: Column) -> Column:
    """Array of (id, priority) of the tasks that a change set asks for."""
    wanted = [F.lit(True), exported > 0, tests == 0, (files >= 10) | (symbols >= 20), failures > 0, missing > 0]
    return F.array_compact(F.array(*[F.when(w, F.struct(F.lit(t).alias("id"), F.lit(p).alias("priority"))) for w, t, p in zip(wanted, TASKS, PRIORITY, strict=True)]))


def recent_first(rows: DataFrame, keys: list[str], order: list[str], keep: int = 5) -> DataFrame:
    """The first ``keep`` rows of each group by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def export_summary(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """(file, exports): exported names of the changed files (file), sorted, each once."""
    rows = symbols.where("exported").join(changed.select("file").distinct(), "file", "left_semi")
    return rows.groupBy("file").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("exports"))


def rename_preview(symbols: DataFrame, edges: DataFrame, target: str, name: str) -> DataFrame:
    """(kind, id, file): the definition and the symbols that refer to it, and symbols of the definition's file that already have ``name``."""
    own = symbols.where(F.col("id") == target)
    users = edges.where((F.col("to_id") == target) & (F.col("from_id") != target)).select(F.col("from_id").alias("id")).distinct()
    part = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), "id", "file")
    clash = symbols.where((F.col("name") == name) & (F.col("id") != target)).join(own.select("file"), "file", "left_semi")
    return part("definition", own).unionByName(part("reference", symbols.join(users, "id", "left_semi"))).unionByName(part("conflict", clash))


def deleted_importers(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """(file, importer, raw): surviving files that import a deleted one (file), with the specifier they use."""
    gone = deleted.select("file").distinct()
    rows = edges.where("to_type = 'file'").join(gone, F.col("to_path") == F.col("file"), "left_semi").join(gone, F.col("from_path") == F.col("file"), "left_anti")
    return rows.select(F.col("to_path").alias("file"), F.col("from_path").alias("importer"), "raw").distinct()


def untested_changes(edges: DataFrame, changed: DataFrame, is_test, depth: int = 2) -> DataFrame:
    """(file) of the changed files that no test reaches within ``depth`` imports and that aren't tests themselves."""
    seeds = changed.select(F.col("file").alias("origin"), F.col("file").alias("node")).distinct()
    tested = graphs.bfs(edges.where("to_type = 'file'"), seeds, depth, "in").where(is_test(F.col("node"))).select(F.col("origin").alias("file")).distinct()
    return changed.select("file").distinct().join(tested, "file", "left_anti")


def breaking_changes(base: DataFrame, head: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, change, users): exported symbols that are gone, no longer exported or of another kind, with the symbols that used them."""
    new = head.select("id", F.col("exported").alias("_e"), F.col("kind").alias("_k"))
    old = base.where("exported").select("id", "kind").join(new, "id", "left")
    change = F.when(F.col("_e").isNull(), "removed").when(~F.col("_e"), "hidden").when(F.col("kind") != F.col("_k"), "kind")
    found = old.select("id", change.alias("change")).where("change is not null")
    users = edges.where("from_id != to_id").select(F.col("to_id").alias("id"), "from_id").distinct().groupBy("id").agg(F.count("*").alias("users"))
    return found.join(users, "id", "left").select("id", "change", F.coalesce("users", F.lit(0)).alias("users"))


def sql_context(facts: DataFrame, changed: DataFrame) -> DataFrame:
    """``facts`` of changed SQL files (path), and facts elsewhere about objects that those files name."""
    near = changed.select("path").distinct()
    names = facts.join(near, "path", "left_semi").select("object_name").distinct()
    inside = facts.join(near, "path", "left_semi").withColumn("reason", F.lit("changed"))
    return inside.unionByName(facts.join(near, "path", "left_anti").join(names, "object_name", "left_semi").select(*facts.columns).withColumn("reason", F.lit("mentioned")))


def aligned(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, n, old, new): values of both sides paired one to one by their place in each group; what has no counterpart stays alone."""
    w = Window.partitionBy(*keys).orderBy(*order)
    side = lambda t, name: t.select(*keys, F.row_number().over(w).alias("n"), F.col(value).alias(name))
    return side(old, "old").join(side(new, "new"), [*keys, "n"], "full_outer")


def enclosing_callable(places: DataFrame, symbols: DataFrame, width: int = 64) -> DataFrame:
    """(file, line, id) of the smallest function or method around each place."""
    return reports.changed_symbols(places, symbols.where(F.col("kind").isin("function", "method", "constructor")), width)


def hinted_pairs(rows: DataFrame, hints: DataFrame, most: int = 200) -> DataFrame:
    """(id_a, id_b) of the units of each two hinted files (file_a, file_b) of one language; files of over ``most`` units are left out, as the hint says little there."""
    sized = rows.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("file")
    use = rows.select("id", "file", "language").join(sized, "file", "left_semi")
    a = use.select(F.col("id").alias("id_a"), F.col("file").alias("file_a"), "language")
    b = use.select(F.col("id").alias("id_b"), F.col("file").alias("file_b"), "language")
    return hints.join(a, "file_a").join(b, ["file_b", "language"]).select("id_a", "id_b").distinct()


def under_roots(files: DataFrame, edges: DataFrame, roots: DataFrame | list[str]) -> tuple[DataFrame, DataFrame]:
    """The files below ``roots``, and the edges among them and from them to the outside.

    Roots typed by a caller are a list, which keeps every file if it is empty;
    any number of them are a table (root), which meets each path's own folders
    in an equi-join.
    """
    if isinstance(roots, DataFrame):
        parts = files.select("path", F.split("path", "/").alias("p")).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", 1, n), "/"))).alias("root"))
        below = parts.join(roots.select(F.regexp_replace("root", "/+$", "").alias("root")), "root", "left_semi").select("path").distinct()
        kept = files.join(below, "path", "left_semi")
    else:
        kept = files.where(under(F.col("path"), roots))
    names = kept.select("path")
    inner = edges.where("to_type = 'file'").join(names, F.col("from_path") == F.col("path"), "left_semi").join(names, F.col("to_path") == F.col("path"), "left_semi")
    outer = edges.where("to_type != 'file'").join(names, F.col("from_path") == F.col("path"), "left_semi")
    return kept, inner.unionByName(outer)


def analysis_summary(files: DataFrame) -> DataFrame:
    """(files, degraded, skipped, native): counts of files (status, engine) by how they were read."""
    count = lambda c, name: F.count_if(c).alias(name)
    return files.agg(F.count("*").alias("files"), count(F.col("status") == "degraded", "degraded"), count(F.col("status") == "skipped", "skipped"), count(F.col("engine") == "native", "native"))


def symbol_graph(symbols: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, file, name) and edges (from_id, to_id, label) of local symbols, import aliases, and the exports that they resolve to.

    ``imports``: (file, alias, target_file, target_name). An alias whose export isn't known has no edge.
    """
    alias = imports.select(F.concat_ws("#", "file", "alias").alias("id"), F.lit("alias").alias("kind"), "file", F.col("alias").alias("name"), "target_file", "target_name").distinct()
    alias = materialise(alias, "aliases")
    nodes = symbols.select("id", "kind", "file", "name").unionByName(alias.select("id", "kind", "file", "name").distinct())
    edges = _resolved(alias, symbols.where("exported").select(F.col("id").alias("to_id"), F.col("file").alias("target_file"), F.col("name").alias("target_name")).distinct())
    return nodes, edges


#: Exports of one target that a task meets with a share of its aliases.
SHARE = 200


def _resolved(alias: DataFrame, exports: DataFrame) -> DataFrame:
    """(from_id, to_id, label) of aliases (id, target_file, target_name) and the distinct ``exports`` of their targets.

    A popular target's exports are dealt to parts of ``SHARE``, each of which
    meets its aliases in a task of its own. Only ids that stand under several
    targets can give an edge twice, so only their edges are compared.
    """
    key = ["target_file", "target_name"]
    use = materialise(exports.join(alias.select(*key).distinct(), key, "left_semi"), "exports")
    many = use.groupBy("to_id").agg(F.count("*").alias("n")).where("n > 1").select("to_id")
    parts = use.groupBy(*key).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts"))
    dealt = use.join(parts, key).withColumn("part", F.pmod(F.xxhash64("to_id"), F.col("parts")).cast("int")).drop("parts")
    asked = alias.select("id", *key).distinct().join(parts, key).select("id", *key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = lambda t: asked.join(t, [*key, "part"]).select(F.col("id").alias("from_id"), "to_id", F.lit("imports").alias("label"))
    return met(dealt.join(many, "to_id", "left_anti")).unionByName(met(dealt.join(many, "to_id", "left_semi")).distinct())
