"""Column functions over text: normalisation, scoring, complexity, path and file predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Words split at camel case and acronyms, lower-cased, everything but letters, digits, marks and ``_`` blanked."""
    t = F.regexp_replace(text, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")
    t = F.regexp_replace(t, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\p{M}_]+", " "))


def compact(norm: Column) -> Column:
    return F.replace(norm, F.lit(" "), F.lit(""))


def query_terms(query: str) -> list[str]:
    """Distinct normalised terms in order; common words go unless nothing else is left."""
    stop = {"the", "a", "an", "of", "to", "in", "is", "and", "or", "for", "where", "how", "what", "does", "do", "with", "on"}
    t = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query)
    t = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", t).lower()
    terms = list(dict.fromkeys(re.findall(r"\w+", t)))
    return [x for x in terms if x not in stop] or terms


def field_score(norm: Column, terms: Sequence[str]) -> Column:
    """Per term: whole word 10, in the text without blanks 7, in the text 4; if all of several match 12 more, then phrase 30 or order 10 more."""
    padded, close = F.concat(F.lit(" "), norm, F.lit(" ")), compact(norm)
    each = [F.when(F.contains(padded, F.lit(f" {t} ")), 10).when(F.contains(close, F.lit(t)), 7).when(F.contains(norm, F.lit(t)), 4).otherwise(0) for t in terms]
    total = sum(each[1:], each[0]) if each else F.lit(0)
    if len(terms) > 1:
        every = F.lit(True)
        for e in each:
            every = every & (e > 0)
        ordered = norm.rlike(".*".join(re.escape(t) for t in terms))
        more = F.when(F.contains(norm, F.lit(" ".join(terms))), 30).when(ordered, 10).otherwise(0)
        total = total + F.when(every, 12 + more).otherwise(0)
    return total.cast("int")


def complexity(text: Column, python: bool = False) -> Column:
    """1 + branch keywords and boolean operators; ``else if`` counts as itself and as ``if``."""
    words = ["if", "for", "while", "case", "catch", r"else\s+if"] + (["elif", "except"] if python else [])
    total = F.lit(1)
    for w in words:
        total = total + F.regexp_count(text, F.lit(rf"\b{w}\b"))
    return (total + F.regexp_count(text, F.lit(r"&&|\|\||\?[^?.]"))).cast("int")


def token_count(text: Column) -> Column:
    """Tokens between white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0b]+"))


# Where tests are, in any case of letters.
TEST_PATTERNS = [r"(^|/)__tests__(/|$)", r"(^|/)test(s)?(/|$)", r"(^|/)spec(s)?(/|$)", r"\.(test|spec)\.[^./]+$", r"(^|/)[^/]*[-_.](test|spec)\.[^./]+$"]


def is_test_file(path: Column, extra: Sequence[str] = ()) -> Column:
    out = F.lit(False)
    for p in [*TEST_PATTERNS, *extra]:
        out = out | path.rlike(f"(?i){p}")
    return out


# Surfaces by the lower-cased path.
DOCS_SUFFIXES = [".md", ".mdx", ".rst", ".adoc", ".txt"]
CONFIG_SUFFIXES = [".json", ".yaml", ".yml", ".toml", ".ini", ".env"]


def surface(path: Column) -> Column:
    """docs, config or code by path."""
    low = F.lower(path)
    ends = lambda names: "|".join(re.escape(n) for n in names)
    return F.when(low.rlike(rf"^readme\.md$|^docs/|({ends(DOCS_SUFFIXES)})$"), "docs").when(low.rlike(rf"({ends(CONFIG_SUFFIXES)})$|^dockerfile$|^\.github/"), "config").otherwise("code")


def under(path: Column, roots: Sequence[str]) -> Column:
    """Equal to a root or below it."""
    out = F.lit(not roots)
    for r in roots:
        r = r.rstrip("/")
        out = out | (path == r) | path.startswith(r + "/")
    return out


def glob_regex(pattern: str) -> str:
    """A regular expression for a path glob with ``**``, ``*``, ``?`` and ``{a,b}``."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            depth, c = depth + 1, "(?:"
        elif c == "}" and depth:
            depth, c = depth - 1, ")"
        elif c == "," and depth:
            c = "|"
        else:
            c = {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        out, i = out + c, i + 1
    return f"^{out}$"


# How SQL files show their role.
SCHEMA_NAMES = ["schema.sql", "structure.sql", "init.sql", "database.sql"]
ROLE_FOLDERS = {
    "dump": ["dump", "dumps", "backup", "backups"],
    "seed": ["seed", "seeds"],
    "fixture": ["fixture", "fixtures", "testdata"],
    "migration": ["migration", "migrations"],
    "routine": ["routine", "routines", "functions", "procedures"],
    "query": ["query", "queries", "reports", "analytics"],
}
MIGRATION_PLACES = ["/db/migrate/", "/schema/migrations/", "/database/migrations/", "/alembic/versions/"]
MIGRATION_NAME = r"^(?:\d{3,}|\d{14}|v\d+__)[\w.-]*\.sql$"
DUMP_TEXT = r"(?i)\b(copy\s+\w+\s+from|load\s+data|pg_dump|mysqldump)\b"
DDL_TEXT = r"(?i)\b(alter\s+table|create\s+index|drop\s+(?:table|column|index|view)|rename\s+to)\b"
QUERY_TEXT = r"(?i)\b(select|with|update|delete|insert\s+into)\b"
TABLE_TEXT = r"(?i)\bcreate\s+table\b"


def sql_role(path: Column, text: Column) -> Column:
    """Role of an SQL file: schema_snapshot, dump, seed, fixture, migration, routine, query or unknown."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    base = F.regexp_extract(low, r"([^/]*)$", 1)
    folder = lambda role: low.rlike("(^|/)(" + "|".join(ROLE_FOLDERS[role]) + ")(/|$)")
    migration = folder("migration") | low.rlike("|".join(MIGRATION_PLACES)) | base.rlike(MIGRATION_NAME)
    return (
        F.when(base.isin(SCHEMA_NAMES) | ((F.regexp_count(text, F.lit(TABLE_TEXT)) >= 2) & ~migration), "schema_snapshot")
        .when(folder("dump") | text.rlike(DUMP_TEXT), "dump")
        .when(folder("seed"), "seed")
        .when(folder("fixture"), "fixture")
        .when(migration | text.rlike(DDL_TEXT), "migration")
        .when(folder("routine"), "routine")
        .when(folder("query") | text.rlike(QUERY_TEXT), "query")
        .otherwise("unknown")
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def ratio(a: Column, b: Column) -> Column:
    """Smaller over greater; 1 for two zeros."""
    high = F.greatest(a, b)
    return F.when(high == 0, 1.0).otherwise(F.least(a, b) / high)


def is_sensitive(path: Column) -> Column:
    """Files that a viewer must not show: environment files, keys, certificates, credential stores."""
    base = F.lower(F.substring_index(path, "/", -1))
    return base.rlike(r"^\.env(\..+)?$|\.(pem|key|p12|pfx|jks|keystore)$|^id_(rsa|dsa|ecdsa|ed25519)$|^(\.netrc|\.npmrc|\.pypirc|credentials|\.htpasswd)$")


def folded(path: Column) -> Column:
    """``path`` without ``.`` and ``..`` segments, in any number; what leads above the top keeps its ``..``."""
    none = F.array().cast("array<string>")
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when((x == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")
