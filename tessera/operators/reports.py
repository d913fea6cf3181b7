"""Changed symbols, review risk, API surface, links and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.textual import folded
from ..storage import materialise, spread
from . import graphs

# --- changes ----------------------------------------------------------------------------------


def hash_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(id, status): added, removed, modified or unchanged by (id, hash)."""
    a, b = base.select("id", F.col("hash").alias("old")), head.select("id", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return a.join(b, "id", "full_outer").select("id", status.alias("status"))


# --- impact -----------------------------------------------------------------------------------


def changed_symbols(lines: DataFrame, symbols: DataFrame, width: int = 64) -> DataFrame:
    """(file, line, id) of the innermost symbol around each changed line; symbols carry ``start`` and ``end``."""
    one = symbols.groupBy("file", "start", "end").agg(F.min("id").alias("id"))  # of equal ranges the least id wins anyway
    ranges = one.select("file", "id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("bin"))
    at = spread(materialise(lines.select("file", "line").distinct(), "lines").withColumn("bin", F.floor(F.col("line") / width)), "file", "bin")
    met = at.join(ranges, ["file", "bin"]).where("line between start and end")
    # grouped by the bin too, so the join's partitions serve
    least = met.groupBy("file", "bin", "line").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("span"), "id")).alias("m"))
    return least.select("file", "line", "m.id")


def review_risk(exported_changed: Column, symbols: Column, files: Column, missing: Column, failures: Column) -> Column:
    """0 to 100 by rules; 70 is high, 40 medium."""
    total = F.when(exported_changed, 60).otherwise(20) + F.when(symbols >= 20, 20).otherwise(0) + F.when(files >= 10, 20).otherwise(0) + F.when(missing > 0, 30).otherwise(0) + F.when(failures > 0, 25).otherwise(0)
    return F.least(F.lit(100), total)


def affected_tests(edges: DataFrame, changed: DataFrame, is_test, depth: int = 1) -> DataFrame:
    """(test, depth, reasons): tests among the changed files and their importers."""
    seeds = changed.select(F.col("file").alias("origin"), F.col("file").alias("node"))
    found = graphs.bfs(edges.where("to_type = 'file'"), seeds, depth, "in")
    tests = found.where(is_test(F.col("node")))
    return tests.groupBy(F.col("node").alias("test")).agg(F.min("depth").alias("depth"), F.array_join(F.sort_array(F.collect_set("origin")), ",").alias("reasons"))


# --- surfaces, links, trees -------------------------------------------------------------------


def unused_exports(symbols: DataFrame, edges: DataFrame, entries: DataFrame | None = None, reexported: DataFrame | None = None, opaque: DataFrame | None = None) -> DataFrame:
    """Exported symbols that no other symbol refers to.

    Left out are those of entry files (``entries``: file), of files that others
    pass on (``reexported``: file), and of files whose importers can't be known,
    as by dynamic imports (``opaque``: file).
    """
    used = edges.where("from_id != to_id").select(F.col("to_id").alias("id"))
    rows = symbols.where("exported").join(used, "id", "left_anti")
    for kept in (entries, reexported, opaque):
        rows = rows if kept is None else rows.join(kept.select("file"), "file", "left_anti")
    return rows.select("id", "name", "file")


def undocumented(symbols: DataFrame) -> DataFrame:
    """(file, names): exported symbols without docstring."""
    bare = symbols.where("exported and (docstring is null or docstring = '')")
    return bare.groupBy("file").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


def symbol_coupling(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_file, to_file, edges) of symbol edges between files."""
    a, b = symbols.select(F.col("id").alias("from_id"), F.col("file").alias("from_file")), symbols.select(F.col("id").alias("to_id"), F.col("file").alias("to_file"))
    return edges.join(a, "from_id").join(b, "to_id").where("from_file != to_file").groupBy("from_file", "to_file").agg(F.count("*").alias("edges"))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, target) of every href."""
    return pages.select(id_col, F.explode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


def broken_links(found: DataFrame, known: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """``found`` (file, destination, ...) with resolved and status.

    The states: ``missing_reference`` (a null destination), ``external``,
    ``outside_root``, ``missing_file``, ``missing_fragment``, ``ok``. Paths are
    relative to the file's folder, or to the root with a leading slash; ``known``:
    (path) of all files and folders; ``anchors``: (path, anchor) of documents,
    which are the only files whose fragments are looked at.
    """
    bare = F.regexp_replace("destination", "[?#].*$", "")
    fragment = F.nullif(F.regexp_extract("destination", "#(.*)$", 1), F.lit(""))
    base = F.regexp_replace("file", "[^/]*$", "")
    place = F.when(bare == "", F.col("file")).when(bare.startswith("/"), bare).otherwise(F.concat(base, bare))
    external = F.col("destination").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:|^//")
    rows = found.select("*", fragment.alias("_fragment"), external.alias("_external"), folded(place).alias("resolved"))
    paths = known.select(F.col("path").alias("resolved")).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(paths, "resolved", "left")
    if anchors is None:
        rows = rows.withColumn("_document", F.lit(None).cast("boolean")).withColumn("_anchor", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(anchors.select(F.col("path").alias("resolved")).distinct().withColumn("_document", F.lit(True)), "resolved", "left")
        rows = rows.join(anchors.select(F.col("path").alias("resolved"), F.col("anchor").alias("_fragment")).distinct().withColumn("_anchor", F.lit(True)), ["resolved", "_fragment"], "left")
    status = (
        F.when(F.col("destination").isNull(), "missing_reference")
        .when(F.col("_external"), "external")
        .when(F.col("resolved").rlike(r"^\.\.(/|$)"), "outside_root")
        .when(F.col("_known").isNull(), "missing_file")
        .when(F.col("_fragment").isNotNull() & F.col("_document") & F.col("_anchor").isNull(), "missing_fragment")
        .otherwise("ok")
    )
    return rows.withColumn("status", status).drop("_fragment", "_external", "_known", "_document", "_anchor")


def tree(paths: DataFrame, depth: int = 3) -> DataFrame:
    """(directory, files) of the directory prefixes up to ``depth``."""
    parts = paths.select(F.split("path", "/").alias("p"))
    rows = parts.where(F.size("p") > 1).select("p", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size("p") - 1))).alias("n"))
    return rows.groupBy(F.array_join(F.slice("p", 1, F.col("n")), "/").alias("directory")).agg(F.count("*").alias("files"))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """(file, ordinal, chunk_id): digest of the text, with a counter from the second occurrence in a file on."""
    digest = F.substring(F.sha2("text", 256), 1, 16)
    w = Window.partitionBy("file", "digest").orderBy("ordinal")
    rows = chunks.select("file", "ordinal", digest.alias("digest")).withColumn("n", F.row_number().over(w) - 1)
    return rows.select("file", "ordinal", F.when(F.col("n") > 0, F.concat_ws(":", "digest", F.col("n").cast("string"))).otherwise(F.col("digest")).alias("chunk_id"))


def retained(snapshots: DataFrame, most: int = 100, time_col: str = "created_at", id_col: str = "id") -> DataFrame:
    """The latest snapshots."""
    return snapshots.orderBy(F.desc(time_col), F.desc(id_col)).limit(most)


def resolution_coverage(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(language, precise, heuristic, none, external) edges of each language's files."""
    count = lambda c, name: F.count_if(c).alias(name)
    inner = F.col("to_type") == "file"
    kind = F.coalesce("resolved", F.lit(""))
    rows = edges.join(files.select(F.col("path").alias("from_path"), "language"), "from_path")
    return rows.groupBy("language").agg(count(inner & (kind == "precise"), "precise"), count(inner & (kind == "heuristic"), "heuristic"), count(inner & (kind == ""), "none"), count(~inner, "external"))


# The attributes that refer to other files.
HTML_ATTRIBUTES = {"script": ["src"], "link": ["href"], "a": ["href"], "img": ["src", "srcset"], "source": ["src", "srcset"], "video": ["src"], "audio": ["src"], "iframe": ["src"], "track": ["src"]}
_TAG = r"""(?i)<(%s)\b((?:[^>"']|"[^"]*"|'[^']*')*)>""" % "|".join(HTML_ATTRIBUTES)
_ATTRIBUTE = r"""(?i)(?<![\w:.-])(href|srcset|src)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def html_references(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, tag, attribute, target) of every reference in a tag, quoted in either way or bare; a srcset has one for each candidate."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    part = lambda text, p, k: F.regexp_extract_all(text, F.lit(p), F.lit(k))
    tags = pages.select(id_col, F.inline(F.arrays_zip(F.transform(part(html, _TAG, 1), F.lower).alias("tag"), part(html, _TAG, 2).alias("body"))))
    rows = tags.select(id_col, "tag", F.inline(F.arrays_zip(F.transform(part(F.col("body"), _ATTRIBUTE, 1), F.lower).alias("attribute"), part(F.col("body"), _ATTRIBUTE, 2).alias("value"))))
    allowed = F.lit(False)
    for tag, names in HTML_ATTRIBUTES.items():
        allowed = allowed | ((F.col("tag") == tag) & F.col("attribute").isin(names))
    value = F.regexp_replace("value", r"""^["']|["']$""", "")
    many = F.transform(F.split(value, ","), lambda x: F.regexp_extract(x, r"^\s*(\S*)", 1))
    out = rows.where(allowed).select(id_col, "tag", "attribute", F.explode(F.when(F.col("attribute") == "srcset", many).otherwise(F.array(F.trim(value)))).alias("target"))
    return out.where("target != ''")
