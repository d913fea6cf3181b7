"""References and regions of markup files, and the names that project manifests give, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each kind of file: how a reference is written and which group is its target.
RULES = {
    "rst": [("link", r"`[^`<]*<([^>`]+)>`__?", 1), ("target", r"(?m)^[ \t]*\.\. _[^:\n]+:[ \t]+(\S+)", 1), ("include", r"(?m)^[ \t]*\.\. (?:include|literalinclude)::[ \t]*(\S+)", 1)],
    "adoc": [("link", r"\blink:([^\[\s]+)\[", 1), ("xref", r"\bxref:([^\[\s]+)\[", 1), ("xref", r"<<([^,>\n]+)(?:,[^>\n]*)?>>", 1), ("include", r"(?m)^include::([^\[\s]+)\[", 1)],
    "hbs": [("partial", r"\{\{>[ \t]*([^\s}]+)", 1)],
    "mdx": [("import", r"""(?m)^import\s[^;\n]*?["']([^"'\n]+)["']""", 1)],
    "css": [("import", r"""@import\s+(?:url\()?["']?([^"')\s;]+)""", 1), ("url", r"""(?<!import )\burl\(\s*["']?([^"')]+)""", 1)],
}


def references(files: DataFrame, kind: str) -> DataFrame:
    """(path, form, target) of every reference in ``files`` (path, text) written as ``kind`` of :data:`RULES`; null text has none."""
    text = F.coalesce("text", F.lit(""))

    def found(form: str, rule: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(rule), F.lit(group)), lambda t: F.struct(F.lit(form).alias("form"), F.trim(t).alias("target")))

    return files.select("path", F.inline(F.concat(*[found(*r) for r in RULES[kind]])))


def component_regions(files: DataFrame) -> DataFrame:
    """(path, ordinal, kind, attributes, start_line, body) of the script, style and template blocks of component files."""
    rule = r"(?s)<(script|style|template)\b([^>]*)>(.*?)</\1>"
    text = F.coalesce("text", F.lit(""))
    part = lambda k: F.regexp_extract_all(text, F.lit(rule), F.lit(k))
    gaps = F.slice(F.split(text, rule, -1), 1, F.size(part(0)))
    rows = files.select("path", F.posexplode(F.arrays_zip(part(0).alias("whole"), part(1).alias("kind"), part(2).alias("attributes"), part(3).alias("body"))).alias("ordinal", "x"), gaps.alias("gaps"), part(0).alias("all"))
    before = F.concat(F.array_join(F.slice("gaps", 1, F.col("ordinal") + 1), ""), F.array_join(F.slice("all", 1, F.col("ordinal")), ""))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return rows.select("path", "ordinal", "x.kind", F.trim("x.attributes").alias("attributes"), line.alias("start_line"), "x.body")


def manifest_names(files: DataFrame) -> DataFrame:
    """(path, name) that a manifest gives its project: JSON manifests, TOML and INI ``name`` keys, Go modules; without one no row."""
    base, text = F.substring_index("path", "/", -1), F.col("text")
    pick = lambda rule: F.nullif(F.regexp_extract(text, rule, 1), F.lit(""))
    name = (
        F.when(base.isin("package.json", "composer.json"), F.get_json_object(text, "$.name"))
        .when(base.isin("pyproject.toml", "Cargo.toml", "setup.cfg"), pick(r"""(?m)^[ \t]*name[ \t]*=[ \t]*["']?([^"'\s]+)"""))
        .when(base == "go.mod", pick(r"(?m)^module[ \t]+(\S+)"))
    )
    return files.select("path", name.alias("name")).where("name is not null")


# --- handles and places -----------------------------------------------------------------------


def place(text: Column) -> Column:
    """(file, line, column) of ``file:line`` or ``file:line:column``; null if it is neither."""
    rule = r"^(.+?):(\d+)(?::(\d+))?$"
    number = lambda k: F.nullif(F.regexp_extract(text, rule, k), F.lit("")).cast("int")
    return F.when(text.rlike(rule), F.struct(F.regexp_extract(text, rule, 1).alias("file"), number(2).alias("line"), number(3).alias("column")))


def handle(kind: Column, *parts: Column) -> Column:
    """``kind:part:part`` with colons and per cent signs inside parts escaped, so that it can be taken apart again."""
    safe = lambda c: F.replace(F.replace(c.cast("string"), F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))
    return F.concat_ws(":", kind, *[safe(p) for p in parts])


def handle_parts(text: Column) -> Column:
    """The kind and parts of a :func:`handle`."""
    return F.transform(F.split(text, ":"), lambda p: F.replace(F.replace(p, F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%")))
