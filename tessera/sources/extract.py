"""Extraction of links, imports, SQL facts and diff lines from text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textual import folded

# --- imports ----------------------------------------------------------------------------------

JS_IMPORT = r"""(?m)(?:^|[;\s])(?:import|export)\s+(?:[\w*{}\s,$]+\s+from\s+)?["']([^"']+)["']|\b(?:require|import)\(\s*["']([^"']+)["']\s*\)"""
PY_IMPORT = r"(?m)^[ \t]*(?:from\s+([.\w]+)\s+import\b|import\s+([.\w]+))"


def import_specifiers(files: DataFrame, language: str = "js") -> DataFrame:
    """(path, ordinal, specifier) of static, re-exporting and dynamic imports."""
    pattern = JS_IMPORT if language == "js" else PY_IMPORT
    a, b = (F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (1, 2))
    both = F.zip_with(a, b, lambda x, y: F.when(x != "", x).otherwise(y))
    return files.select("path", F.posexplode(both).alias("ordinal", "specifier"))


EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".py"]


def resolve_imports(imports: DataFrame, files: DataFrame, extensions: Sequence[str] = tuple(EXTENSIONS), paths: dict[str, Sequence[str]] | None = None, packages: DataFrame | None = None, path_like: bool = False, node_modules: bool = False, hints: Sequence[str] = ()) -> DataFrame:
    """``imports`` (path, specifier, ...) with to_path and to_type: the first existing candidate, else external.

    A place is tried as it stands, with each extension, and as a folder's index
    with each extension. The places, in order:

    * of a relative specifier, the importer's folder with it; of one from the root, the root with it;
    * of a bare one: the targets of a matching pattern in ``paths`` (one ``*`` stands for any text; the longest text before it goes first);
    * the folder of a workspace package (``packages``: name, folder) with what follows its name;
    * with ``path_like``, the root with the specifier, dots standing for slashes if it has none;
    * with ``node_modules``, these folders from the importer's upwards;
    * each of the ``hints``, folders that a caller knows.

    Candidates are exploded with their place and met by one equi-join; the least
    place wins. Paths that lead out of the root match no file.
    """
    pairs = imports.select("path", "specifier").distinct()
    spec, folder = F.col("specifier"), F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/$", "")
    relative, rooted = spec.rlike(r"^\.{1,2}(/|$)"), spec.startswith("/")
    bare = ~(relative | rooted)
    none = F.array().cast("array<string>")
    places = [F.when(relative, F.array(F.concat_ws("/", folder, spec))).when(rooted, F.array(spec)).otherwise(none)]
    for pattern, targets in sorted((paths or {}).items(), key=lambda p: -len(p[0].split("*")[0])):
        head, star, tail = pattern.partition("*")
        if star:
            fits = spec.startswith(head) & spec.endswith(tail) & (F.length(spec) >= len(head) + len(tail))
            middle = F.substring(spec, F.lit(len(head) + 1), F.length(spec) - len(head) - len(tail))
            made = [F.concat(F.lit(t.partition("*")[0]), middle, F.lit(t.partition("*")[2])) if "*" in t else F.lit(t) for t in targets]
        else:
            fits, made = spec == pattern, [F.lit(t) for t in targets]
        places.append(F.when(bare & fits, F.array(*made)).otherwise(none))
    if packages is not None:
        own = packages.select(F.col("name").alias("_p"), F.col("folder").alias("_folder"))
        pairs = pairs.join(own, package_name(spec) == F.col("_p"), "left")
        places.append(F.when(bare & F.col("_folder").isNotNull(), F.array(F.concat("_folder", F.substring(spec, F.length("_p") + 1, F.length(spec))))).otherwise(none))
    if path_like:
        places.append(F.when(bare, F.array(F.when(spec.contains("/"), spec).otherwise(F.translate(spec, ".", "/")))).otherwise(none))
    if node_modules:
        ups = F.split(folder, "/")
        above = F.transform(F.sequence(F.size(ups), F.lit(0), F.lit(-1)), lambda n: F.concat_ws("/", F.array_join(F.slice(ups, 1, n), "/"), F.lit("node_modules"), spec))
        places.append(F.when(bare, above).otherwise(none))
    if hints:
        places.append(F.array(*[F.concat_ws("/", F.lit(h), spec) for h in hints]))
    forms = lambda p: F.array(p, *[F.concat(p, F.lit(e)) for e in extensions], *[F.concat(p, F.lit(f"/index{e}")) for e in extensions])
    options = F.flatten(F.transform(F.concat(*places), lambda p: forms(folded(p))))
    tries = pairs.select("path", "specifier", F.posexplode(options).alias("place", "to_path"))
    known = files.select(F.col("path").alias("to_path")).distinct()
    hits = tries.join(known, "to_path").groupBy("path", "specifier").agg(F.min_by("to_path", "place").alias("to_path"))
    rows = imports.join(hits, ["path", "specifier"], "left")
    return rows.withColumn("to_type", F.when(F.col("to_path").isNull(), "external").otherwise("file")).withColumn("to_path", F.coalesce("to_path", "specifier"))


STDLIB = ["fs", "path", "os", "http", "https", "url", "util", "crypto", "stream", "events", "sys", "re", "json", "typing", "collections", "itertools"]


def package_name(specifier: Column) -> Column:
    """``@scope/name`` or the first segment."""
    return F.regexp_extract(specifier, r"^(?:node:)?((?:@[^/]+/)?[^/]+)", 1)


def classify_external(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """``imports`` with class: url, stdlib, package (declared in ``packages.name``) or unresolved."""
    name = package_name(F.col("specifier"))
    declared = packages.select(F.col("name").alias("_p")).distinct()
    rows = imports.withColumn("_n", name).join(declared, F.col("_n") == F.col("_p"), "left")
    kind = F.when(F.col("specifier").rlike("^[a-z]+://|^//"), "url").when(F.col("specifier").startswith("node:") | F.col("_n").isin(*STDLIB), "stdlib").when(F.col("_p").isNotNull(), "package").otherwise("unresolved")
    return rows.withColumn("class", kind).drop("_n", "_p")


# --- links ------------------------------------------------------------------------------------


def markdown_links(files: DataFrame) -> DataFrame:
    """(path, kind, destination, missing_reference): inline, autolink and reference links outside code; images are skipped."""
    bare = F.regexp_replace("text", r"(?ms)^(```|~~~).*?^\1[^\n]*$", "")
    bare = F.regexp_replace(bare, r"(`+)[^`].*?\1", "")
    rows = files.select("path", F.explode(F.array(bare)).alias("t"))
    part = lambda kind, pattern, t=F.col("t"): F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))
    defined = F.map_from_entries(F.array_distinct(F.zip_with(F.regexp_extract_all("t", F.lit(r"(?m)^ {0,3}\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s|$)"), F.lit(1)), F.regexp_extract_all("t", F.lit(r"(?m)^ {0,3}\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s|$)"), F.lit(2)), lambda k, v: F.struct(F.lower(k), v))))
    found = F.concat(part("inline", r"(?<!!)\[[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)"), part("autolink", r"<([a-zA-Z][a-zA-Z0-9+.-]*:[^>\s]+)>"), part("reference", r"(?<!!)\[[^\]]+\]\[([^\]]+)\]"))
    out = rows.select("path", defined.alias("d"), F.explode(found).alias("l"))
    target = F.when(F.col("l.kind") == "reference", F.try_element_at("d", F.lower("l.x"))).otherwise(F.col("l.x"))
    return out.select("path", F.col("l.kind").alias("kind"), target.alias("destination"), (F.col("l.kind").eqNullSafe("reference") & target.isNull()).alias("missing_reference"))


# --- SQL facts --------------------------------------------------------------------------------

_NAME = r"((?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\])(?:\.(?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\]))*)"
_RULES = [
    ("defines_table", re.compile(rf"^create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?{_NAME}", re.I)),
    ("defines_view", re.compile(rf"^create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?{_NAME}", re.I)),
    ("defines_index", re.compile(rf"^create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?{_NAME}\s+on\s+{_NAME}", re.I)),
    ("defines_routine", re.compile(rf"^create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+{_NAME}", re.I)),
    ("alters", re.compile(rf"^alter\s+table\s+(?:if\s+exists\s+)?{_NAME}", re.I)),
    ("drops", re.compile(rf"^drop\s+(?:table|view|index)\s+(?:if\s+exists\s+)?{_NAME}", re.I)),
    ("writes", re.compile(rf"^(?:insert\s+into|update|delete\s+from|merge\s+into)\s+{_NAME}", re.I)),
]
_READ, _REFERS = re.compile(rf"\b(from|join)\s+{_NAME}", re.I), re.compile(rf"\breferences\s+{_NAME}", re.I)
_CTE = re.compile(r"(?:\bwith\s+(?:recursive\s+)?|,\s*)(\w+)\s*(?:\([^)]*\))?\s+as\s*\(", re.I)
_QUOTED = re.compile(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/|\$(\w*)\$.*?\$\1\$", re.S)


def sql_statements(text: str) -> Iterator[tuple[int, int, str]]:
    """(start line, end line, masked statement): comments and string literals blanked, split at ``;`` and ``GO`` lines."""
    masked = _QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    at = 0
    for m in re.finditer(r";|^[ \t]*go[ \t]*$|\Z", masked, re.I | re.M):
        body = masked[at : m.start()]
        if body.strip():
            lead = at + len(body) - len(body.lstrip())
            yield masked.count("\n", 0, lead) + 1, masked.count("\n", 0, at + len(body.rstrip())) + 1, body.strip()
        at = m.end()


def lookup_name(name: str) -> str:
    """Unquoted parts in lower case, quoted ones as they are."""
    parts = re.findall(r"\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|[^.]+", name)
    return ".".join(p[1:-1] if p[0] in "\"`[" else p.lower() for p in parts)


def facts_of(text: str) -> Iterator[tuple[int, int, str, str, str | None]]:
    """(start line, end line, kind, object, related object)."""
    for first, last, body in sql_statements(text):
        own = None
        for kind, rule in _RULES:
            if m := rule.search(body):
                own = lookup_name(m[1])
                yield first, last, kind, own, lookup_name(m[2]) if kind == "defines_index" else None
                break
        local = {x.lower() for x in _CTE.findall(body)}
        for m in _READ.finditer(body):
            if (name := lookup_name(m[2])) not in local and not re.match(r"delete\s+from", body[max(0, m.start() - 8) : m.end()].lstrip(), re.I):
                yield first, last, "joins" if m[1].lower() == "join" else "reads", name, own
        for m in _REFERS.finditer(body):
            yield first, last, "references", lookup_name(m[1]), own


def sql_facts(files: DataFrame) -> DataFrame:
    """(path, start_line, end_line, kind, object_name, related_object_name) of all statements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *f) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in facts_of(t or "")]
            if rows:
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "start_line", "end_line", "kind", "object_name", "related_object_name"])

    return files.select("path", "text").mapInArrow(run, "path string, start_line int, end_line int, kind string, object_name string, related_object_name string")


def sql_lineage(facts: DataFrame) -> DataFrame:
    """(object_name, path, defined_in): reads and joins with the file that defines the object, by full name, else by a base name that is unique."""
    uses = facts.where("kind in ('reads', 'joins', 'references', 'writes')").select("object_name", "path").distinct()
    made = facts.where("kind in ('defines_table', 'defines_view')").select("object_name", F.col("path").alias("defined_in")).distinct()
    exact = uses.join(made, "object_name")
    base = F.substring_index("object_name", ".", -1).alias("base")
    single = made.select(base, "object_name", "defined_in").groupBy("base").agg(F.count("*").alias("n"), F.first("defined_in").alias("defined_in")).where("n = 1").drop("n")
    rest = uses.join(made, "object_name", "left_anti").select("object_name", "path", base).join(single, "base", "left").drop("base")
    return exact.select("object_name", "path", "defined_in").unionByName(rest.select("object_name", "path", "defined_in"))


# --- diffs ------------------------------------------------------------------------------------

_HUNK = re.compile(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")


def diff_rows(text: str) -> Iterator[tuple[str, str | None, str, int, str, int, int, int | None]]:
    """(path, old path, change, hunk, sign, old line, new line, changed line) of a unified diff's lines.

    The changed line is where an edit shows in the new file: an added line
    itself; a removed one the next new line, plus its place in the run of
    removals; the old line if the file has no new lines.
    """
    path = old = None
    kind, hunk, a, b, streak = "modified", 0, 0, 0, 0
    for line in text.split("\n"):
        if line.startswith("diff --git "):
            m = re.match(r"diff --git a/(.*) b/(.*)$", line)
            path, old, kind, hunk = (m[2] if m else None), None, "modified", 0
        elif line.startswith("new file"):
            kind = "added"
        elif line.startswith("deleted file"):
            kind = "deleted"
        elif line.startswith("rename from "):
            kind, old = "renamed", line[12:]
        elif line.startswith("Binary files ") and path:
            yield path, old, "binary", 0, " ", 0, 0, None
        elif line.startswith(("--- ", "+++ ")) and not a:
            name = line[4:].split("\t")[0]
            if name != "/dev/null":
                path = re.sub("^[ab]/", "", name)
        elif m := _HUNK.match(line):
            hunk, a, b, streak = hunk + 1, int(m[1]), int(m[2]), 0
        elif path and hunk and line[:1] in "+- " and line:
            sign = line[0]
            changed = None if sign == " " else b if sign == "+" else b + streak if b else a
            yield path, old, kind, hunk, sign, a if sign != "+" else 0, b if sign != "-" else 0, changed
            streak = streak + 1 if sign == "-" else 0
            a += line[0] != "+"
            b += line[0] != "-"
            continue
        if not line.startswith("@@"):
            a = 0 if line.startswith("diff ") else a


def parse_diff(diffs: DataFrame) -> DataFrame:
    """(id, path, old_path, change, hunk, sign, old_line, new_line, changed_line) of ``diffs`` (id, text)."""
    names = ["id", "path", "old_path", "change", "hunk", "sign", "old_line", "new_line", "changed_line"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in diff_rows(t or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return diffs.select(F.col("id").cast("string"), "text").mapInArrow(run, "id string, path string, old_path string, change string, hunk int, sign string, old_line int, new_line int, changed_line int")


def sql_graph(facts: DataFrame) -> DataFrame:
    """(source, target, kind): files contain statements, which define, read, join, ... objects."""
    stmt = F.concat(F.lit("statement:"), "path", F.lit("#"), F.col("start_line").cast("string"))
    inside = facts.select(F.concat(F.lit("file:"), "path").alias("source"), stmt.alias("target"), F.lit("contains").alias("kind"))
    uses = facts.select(stmt.alias("source"), F.concat(F.lit("object:"), "object_name").alias("target"), F.regexp_replace("kind", "_.*", "").alias("kind"))
    return inside.unionByName(uses).distinct()


# --- coverage ---------------------------------------------------------------------------------


def lcov_lines(reports: DataFrame) -> DataFrame:
    """(path, line, hits) of LCOV ``text``: the sum over records of one line; malformed records give no rows."""
    record = reports.select(F.explode(F.split("text", "end_of_record")).alias("r"))
    path = F.trim(F.regexp_extract("r", r"(?m)^SF:(.*)$", 1))
    part = lambda k: F.regexp_extract_all("r", F.lit(r"(?m)^DA:(\d+),(\d+)"), F.lit(k))
    rows = record.select(path.alias("path"), F.inline(F.arrays_zip(part(1).alias("line"), part(2).alias("hits")))).where("path != ''")
    return rows.groupBy("path", F.col("line").cast("int").alias("line")).agg(F.sum(F.col("hits").cast("long")).alias("hits"))
