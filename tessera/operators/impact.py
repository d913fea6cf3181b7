"""Change impact: severities, direct references, seeds, propagation over importers, budgets, the report's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise
from . import graphs

# The weights that scores must agree on.
REASON_WEIGHT = {"directRef": 1.0, "namespaceMember": 0.8, "importAlias": 0.6, "fileLevelChange": 0.4 * 0.9, "transitive": 0.4}
REASON_CONFIDENCE = {"directRef": 1.0, "namespaceMember": 0.9, "importAlias": 0.85, "fileLevelChange": 0.5, "transitive": 0.6}
RESOLUTION = {"medium": 0.85, "low": 0.6}
#: Reasons from the strongest to the weakest.
REASONS = ["directRef", "namespaceMember", "importAlias", "transitive", "fileLevelChange"]
MAX_SYMBOLS, MAX_LOOKUPS, MAX_REFERENCES = 250, 250, 5000
TOP = 10


def _pick(key: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def confidence(reason: Column, resolution: Column, depth: Column) -> Column:
    """How sure a reference is, by its reason, its resolution (high, medium, low or null) and its depth."""
    return _pick(reason, REASON_CONFIDENCE, REASON_CONFIDENCE["transitive"]) * _pick(resolution, RESOLUTION, 1.0) * F.pow(F.lit(0.9), depth)


def severity(reason: Column, exported: Column, fan_in: Column, same_file: Column, type_only: Column, depth: Column, sure: Column) -> Column:
    """s / (1 + s) of the product of the weights and the confidence ``sure``."""
    s = (
        _pick(reason, REASON_WEIGHT, REASON_WEIGHT["transitive"])
        * F.when(exported, 1.2).otherwise(1.0)
        * F.when(fan_in > 0, 1 + F.least(F.log10(fan_in + F.lit(1)), F.lit(1.0))).otherwise(1.0)
        * F.when(same_file, 1.2).otherwise(1.0)
        * F.when(type_only, 0.7).otherwise(1.0)
        * F.pow(F.lit(0.8), depth)
        * sure
    )
    return s / (1 + s)


def transitive_severity(type_only: Column, depth: Column) -> Column:
    return F.lit(0.3) * F.when(type_only, 0.6).otherwise(1.0) * F.pow(F.lit(0.7), depth)


def fan_in(edges: DataFrame) -> DataFrame:
    """(file, fan_in, importers): dependency statistics of every imported file; importers are counted once in ``importers``."""
    inner = edges.where("to_type = 'file'")
    return inner.groupBy(F.col("to_path").alias("file")).agg(F.count("*").alias("fan_in"), F.countDistinct("from_path").alias("importers"))


def ranked_symbols(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """``changed`` (id, file, name, kind, exported, signature_changed, start) with ``place``: changed signatures, exports, imported files, callables before others and variables last, fan-in, then position."""
    kind = F.when(F.col("kind").isin("function", "method", "constructor"), 0).when(F.col("kind") == "variable", 2).otherwise(1)
    stats = fan_in(edges).select(F.col("file").alias("_f"), F.col("fan_in").alias("_n"))
    rows = changed.join(stats, F.col("file") == F.col("_f"), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    order = [(~F.col("signature_changed")).cast("int"), (~F.col("exported")).cast("int"), (F.col("_n") == 0).cast("int"), kind, -F.col("_n"), F.col("file"), F.col("start"), F.col("id")]
    key = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
    return rows.withColumn("order", key).drop("_f", "_n")


def budgeted(changed: DataFrame, edges: DataFrame, limit: int = MAX_SYMBOLS) -> DataFrame:
    """The ``limit`` changed symbols that are looked at first."""
    return ranked_symbols(changed, edges).orderBy("order").limit(limit).drop("order")


def direct_references(changed: DataFrame, refs: DataFrame, edges: DataFrame, exclude: Column | None = None, keep: int | None = None) -> DataFrame:
    """(file, severity, confidence, reasons, symbols, resolution): files that refer to changed symbols, strongest evidence first.

    ``refs``: (def_id, file, reason, resolution). ``exclude`` names files that
    don't count (tests, ignored paths); ``keep`` bounds the references of a symbol.
    """
    sides = changed.select(F.col("id").alias("def_id"), F.col("name").alias("symbol"), F.col("file").alias("def_file"), "exported", "type_only")
    rows = refs if exclude is None else refs.where(~exclude)
    if keep is not None:
        w = Window.partitionBy("def_id").orderBy("file", "reason", F.coalesce("resolution", F.lit("")))
        rows = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep).drop("_k")
    rows = rows.groupBy("def_id", "file", "reason", "resolution").agg(F.count("*").alias("n"))  # equal references weigh alike
    stats = fan_in(edges).select("file", "fan_in")
    sure = confidence(F.col("reason"), F.col("resolution"), F.lit(0))
    both = rows.join(sides, "def_id").join(stats, "file", "left").withColumn("sure", sure)
    graded = both.withColumn("severity", severity(F.col("reason"), F.col("exported"), F.coalesce("fan_in", F.lit(0)), F.col("file") == F.col("def_file"), F.col("type_only"), F.lit(0), F.col("sure")))
    worst = F.max(F.when(F.col("resolution") == "low", 2).when(F.col("resolution") == "medium", 1).otherwise(0))
    best = F.max(F.struct("severity", "sure"))
    out = graded.groupBy("file").agg(best.alias("b"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"), F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"), worst.alias("w"))
    return out.select("file", "b.severity", F.col("b.sure").alias("confidence"), "reasons", "symbols", F.when(F.col("w") == 2, "low").when(F.col("w") == 1, "medium").alias("resolution"))


def seeds(edges: DataFrame, changes: DataFrame, impacted: DataFrame, exclude: Column | None = None) -> DataFrame:
    """(file, severity, confidence, reason): importers of deleted and renamed files, and of files that changed without symbols.

    ``changes``: (path, old_path, kind, whole), ``whole`` for changes to a file as a
    whole (binary, mode, no hunks). Files in ``impacted`` (file) are known already.
    """
    gone = changes.where("kind in ('deleted', 'renamed')")
    places = gone.select(F.col("path").alias("to_path")).union(gone.where("kind = 'renamed' and old_path is not null").select("old_path")).distinct()
    level = changes.where("kind in ('added', 'modified') and whole").select(F.col("path").alias("to_path")).join(impacted.select(F.col("file").alias("to_path")), "to_path", "left_anti").distinct()
    inner = edges.where("to_type = 'file' and from_path != to_path").select("from_path", "to_path").distinct()
    hit = lambda t, s, r: inner.join(t, "to_path", "left_semi").select(F.col("from_path").alias("file"), F.lit(s).alias("severity"), F.lit(0.5).alias("confidence"), F.lit(r).alias("reason"))
    rows = hit(places, 0.6, "transitive").unionByName(hit(level, 0.45, "fileLevelChange"))
    rows = rows.join(impacted.select("file"), "file", "left_anti")
    rows = rows if exclude is None else rows.where(~exclude)
    return rows.groupBy("file").agg(F.max(F.struct("severity", "confidence", "reason")).alias("b")).select("file", "b.*")


def propagate(edges: DataFrame, start: DataFrame, depth: int = 3, exclude: Column | None = None) -> DataFrame:
    """(file, depth, severity, confidence, seed): the files of ``start`` and their importers, relaxed level by level.

    ``start``: (file) or (file, depth, severity, confidence). Each step over an
    edge takes the confidence by 0.85 (0.75 if type-only) and by 0.95 to the depth
    it leaves from, within 0.2 and 1. A file that improves in depth, severity or
    confidence, or is reached for the first time, goes on into the next level, so
    a longer but stronger route still counts. ``exclude`` is a condition on
    ``file``. The work of a level is one join of the improved files.
    """
    links = edges.where("to_type = 'file' and from_path != to_path").groupBy("from_path", "to_path").agg(F.bool_and(F.coalesce("type_only", F.lit(False))).alias("type_only"))
    links = materialise(links if exclude is None else links.withColumn("file", F.col("from_path")).where(~exclude).drop("file"), "impact-links")
    first = {"depth": F.lit(0), "severity": F.lit(1.0), "confidence": F.lit(1.0)}
    rows = start.select("file", *[(F.col(c) if c in start.columns else v).alias(c) for c, v in first.items()])
    known = rows.groupBy("file").agg(F.min("depth").alias("depth"), F.max("severity").alias("severity"), F.max("confidence").alias("confidence")).withColumn("seed", F.lit(True)).withColumn("reached", F.lit(False))
    known = materialise(known, "impact")
    base = known.agg(F.min("depth")).first()[0]
    front = known.where(F.col("depth") == base).select("file")
    for d in range(base or 0, depth):
        up = front.join(known.select("file", "confidence"), "file").join(links, F.col("file") == F.col("to_path"))
        sure = F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.col("confidence") * F.when(F.col("type_only"), 0.75).otherwise(0.85) * 0.95**d))
        step = up.select(F.col("from_path").alias("file"), transitive_severity(F.col("type_only"), F.lit(d + 1)).alias("s"), sure.alias("c"))
        step = step.groupBy("file").agg(F.max("s").alias("s"), F.max("c").alias("c"))
        both = known.join(step, "file", "full_outer")
        better = F.col("s").isNotNull() & (F.col("depth").isNull() | (F.col("depth") > d + 1) | (F.col("s") > F.col("severity")) | (F.col("c") > F.col("confidence")) | ~F.col("reached"))
        both = both.select(
            "file",
            F.least("depth", F.when(F.col("s").isNotNull(), d + 1)).alias("depth"),
            F.greatest("severity", "s").alias("severity"),
            F.greatest("confidence", "c").alias("confidence"),
            F.coalesce("seed", F.lit(False)).alias("seed"),
            (F.coalesce("reached", F.lit(False)) | F.col("s").isNotNull()).alias("reached"),
            F.coalesce(better, F.lit(False)).alias("better"),
        )
        both = materialise(both, "impact")
        known = both.drop("better")
        front = both.where(F.col("better") | ((F.col("depth") == d + 1) & F.col("seed") & ~F.col("reached"))).select("file")
        if front.isEmpty():
            break
    return known.drop("reached")


def ordered(items: DataFrame) -> list[Column]:
    """The order of impacted files: severity, confidence, depth, file, first symbol."""
    first = [F.col("symbols")] if "symbols" in items.columns else []
    return [F.desc("severity"), F.desc("confidence"), F.asc("depth"), F.asc("file"), *first]


def analysed(edges: DataFrame, changed: DataFrame, refs: DataFrame, changes: DataFrame, depth: int = 3, exclude: Column | None = None) -> DataFrame:
    """(file, depth, severity, confidence, reasons, symbols): direct references, seeds and what they reach, as one table."""
    direct = materialise(direct_references(changed, refs, edges, exclude), "impact-direct")
    more = seeds(edges, changes, direct, exclude)
    start = direct.select("file", F.lit(0).alias("depth"), "severity", "confidence").unionByName(more.select("file", F.lit(1).alias("depth"), "severity", "confidence"))
    found = propagate(edges, materialise(start, "impact-start"), depth, exclude)
    told = direct.select("file", "reasons", "symbols").unionByName(more.select("file", F.col("reason").alias("reasons"), F.lit("").alias("symbols")))
    rows = found.join(told, "file", "left")
    return rows.select("file", "depth", "severity", "confidence", F.coalesce("reasons", F.lit("transitive")).alias("reasons"), F.coalesce("symbols", F.lit("")).alias("symbols"))


def clusters(edges: DataFrame, changed: DataFrame, impacted: DataFrame) -> DataFrame:
    """(component, files, changed_files, total_severity) over the edges among changed (file) and impacted files (file, severity)."""
    from .components import connected_components

    touched = changed.select("file").union(impacted.select("file")).distinct()
    inner = edges.where("to_type = 'file'").join(touched, F.col("from_path") == F.col("file"), "left_semi").join(touched, F.col("to_path") == F.col("file"), "left_semi")
    loops = touched.select(F.col("file").alias("src"), F.col("file").alias("dst"))
    found = connected_components(inner.select(F.col("from_path").alias("src"), F.col("to_path").alias("dst")).unionByName(loops)).withColumnRenamed("node", "file")
    marks = changed.select("file").distinct().withColumn("changed", F.lit(1))
    sums = impacted.groupBy("file").agg(F.sum("severity").alias("severity"))
    rows = found.join(marks, "file", "left").join(sums, "file", "left")
    return rows.groupBy("component").agg(F.count("*").alias("files"), F.count("changed").alias("changed_files"), F.coalesce(F.sum("severity"), F.lit(0.0)).alias("total_severity"))


def impact_cycles(edges: DataFrame, changed: DataFrame, impacted: DataFrame) -> DataFrame:
    """(files, size, priority, touches_changed, touches_impacted, severity): cycles that hold a changed (high) or an impacted file (medium)."""
    labels = materialise(graphs.cycle_labels(edges), "impact-cycles")
    mark = lambda t, name: t.select(F.col("file").alias("node")).distinct().withColumn(name, F.lit(True))
    touched = labels.join(mark(changed, "c"), "node", "left").join(mark(impacted, "i"), "node", "left").groupBy("component").agg(F.coalesce(F.bool_or("c"), F.lit(False)).alias("touches_changed"), F.coalesce(F.bool_or("i"), F.lit(False)).alias("touches_impacted"))
    rows = graphs.cycles(edges, labels).join(touched, "component").where("touches_changed or touches_impacted")
    return rows.select("files", "size", "priority", "touches_changed", "touches_impacted", F.when(F.col("touches_changed"), "high").otherwise("medium").alias("severity"))


def surface_tops(surface: DataFrame, limit: int = TOP) -> DataFrame:
    """(side, place, file): the files with the most importers and with the most imports."""
    part = lambda side: surface.orderBy(F.desc(side), "file").limit(limit).select(F.lit(side).alias("side"), "file", F.col(side).alias("_n"))
    w = Window.partitionBy("side").orderBy(F.desc("_n"), "file")  # at most 2 * limit rows
    return part("fan_in").unionByName(part("fan_out")).select("side", F.row_number().over(w).alias("place"), "file")


def reexport_chains(reexports: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """(symbol, path array): ways of an exported changed symbol (id, file, name) out of its file, without a repeated file.

    ``reexports``: (source, exporter, form, name); the form ``reexport`` passes on the one ``name``, ``exportStar`` and ``namespaceReexport`` everything.
    """
    use = reexports.select("source", "exporter", "form", "name").distinct()
    level = changed.where("exported").select(F.col("id").alias("symbol"), F.col("name").alias("wanted"), F.array("file").alias("path"))
    out = None
    for _ in range(depth):
        met = level.join(use, F.element_at("path", -1) == F.col("source")).where((F.col("form") != "reexport") | (F.col("name") == F.col("wanted")))
        level = met.where(~F.array_contains("path", F.col("exporter"))).select("symbol", "wanted", F.concat("path", F.array("exporter")).alias("path")).distinct()
        out = level if out is None else out.unionByName(level)
    return out.select("symbol", "path")


def compact(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, file) and ``items`` with file_id in place of the path: numbers follow the sorted paths."""
    paths = items.select("file").distinct()
    placed = materialise(paths.repartitionByRange("file").sortWithinPartitions("file").withColumn("_p", F.spark_partition_id()), "paths")
    w = Window.partitionBy("_p").orderBy("file")
    sizes = sorted((r["_p"], r["count"]) for r in placed.groupBy("_p").count().collect())  # one number a range
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    base = items.sparkSession.createDataFrame(starts, "_p int, _b long")
    book = placed.join(F.broadcast(base), "_p").select((F.col("_b") + F.row_number().over(w) - 1).alias("file_id"), "file")
    book = materialise(book, "paths")
    return book, items.join(book, "file").drop("file")


def streamed(items: DataFrame) -> DataFrame:
    """(phase, file, severity): partial rows by depth and file, then the final rows in the report's order; ``place`` numbers each phase."""
    partial = items.select(F.lit("partial").alias("phase"), "file", "severity", F.struct(F.col("depth").alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), "file").alias("o"))
    final = items.select(F.lit("final").alias("phase"), "file", "severity", F.struct(F.lit(0).alias("a"), (-F.col("severity")).alias("b"), (-F.col("confidence")).alias("c"), "file").alias("o"))
    return partial.unionByName(final)
