"""Ranked search over chunks, symbols and paths, hybrid merges, text grep and workspace symbols."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.textual import compact, field_score, normalized, query_terms, surface
from ..storage import materialise
from . import graphs


def search_text(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, file, score): best chunks; texts without any term never reach the scorer."""
    terms = query_terms(query)
    rows = chunks.select("id", "file", F.explode(F.array(normalized(F.col("text")))).alias("norm"))
    close, hit = compact(F.col("norm")), F.lit(False)
    for t in terms:
        hit = hit | F.contains(close, F.lit(t))
    scored = rows.where(hit).select("id", "file", field_score(F.col("norm"), terms).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "file", "id").limit(limit)


def search_symbols(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, name, file, score) with 4 * name + file + docstring + 5 if exported."""
    terms = query_terms(query)
    part = lambda c: field_score(normalized(F.coalesce(c, F.lit(""))), terms)
    base = 4 * part("name") + part("file") + part("docstring")
    rows = symbols.select("id", "name", "file", "exported", base.alias("base")).where("base > 0")
    return rows.select("id", "name", "file", (F.col("base") + F.when(F.col("exported"), 5).otherwise(0)).alias("score")).orderBy(F.desc("score"), "file", "id").limit(limit)


def search_paths(files: DataFrame, query: str, limit: int = 20) -> DataFrame:
    rows = files.select("path", (2 * field_score(normalized(F.col("path")), query_terms(query))).alias("score"))
    return rows.where("score > 0").orderBy(F.desc("score"), "path").limit(limit)


def search_graph(files: DataFrame, edges: DataFrame, query: str, start: str, depth: int = 3, limit: int = 20) -> DataFrame:
    """Path scores with max(2, 14 - 3 * distance) more for files in the neighbourhood of ``start``."""
    near = graphs.bfs(edges.where("to_type = 'file'"), graphs.seeds_of(edges, [start]), depth, "both").select(F.col("node").alias("path"), F.greatest(F.lit(2), 14 - 3 * F.col("depth")).alias("boost"))
    rows = files.select("path", (2 * field_score(normalized(F.col("path")), query_terms(query))).alias("base")).join(near, "path", "left")
    return rows.select("path", (F.col("base") + F.coalesce("boost", F.lit(0))).alias("score")).where("score > 0").orderBy(F.desc("score"), "path").limit(limit)


def merge_results(*results: DataFrame, limit: int = 20) -> DataFrame:
    """Results (handle, score, reason) of several searches: scores add up, reasons unite."""
    rows = results[0]
    for r in results[1:]:
        rows = rows.unionByName(r)
    merged = rows.groupBy("handle").agg(F.sum("score").alias("score"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    return merged.orderBy(F.desc("score"), "handle").limit(limit)


def search_hybrid(symbols: DataFrame, files: DataFrame, chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Files by the summed scores of symbol, path and text hits."""
    a = search_symbols(symbols, query, limit).select(F.col("file").alias("handle"), "score", F.lit("symbol").alias("reason"))
    b = search_paths(files, query, limit).select(F.col("path").alias("handle"), "score", F.lit("path").alias("reason"))
    c = search_text(chunks, query, limit).select(F.col("file").alias("handle"), "score", F.lit("text").alias("reason"))
    return merge_results(a, b, c, limit=limit)


def grep(chunks: DataFrame, pattern: str, ignore_case: bool = False, limit: int | None = 5000) -> DataFrame:
    """(file, line, column, match, snippet) of every match; lines and columns from 1, Java regular expressions."""
    java = f"(?i){pattern}" if ignore_case else pattern
    hits = chunks.where(F.col("text").rlike(java))
    lines = hits.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "s")).where(F.col("s").rlike(java))
    found = F.regexp_extract_all("s", F.lit(java), F.lit(0))
    gaps = F.split("s", java, -1)
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"]) + 1).alias("column"), x["m"].alias("match")))).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<column:int,match:string>>").alias("out"))
    spans = F.aggregate(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")), zero, step, lambda acc: acc["out"])
    rows = lines.select("file", (F.col("n") + 1).alias("line"), "s", F.inline(spans)).select("file", "line", "column", "match", F.substring(F.trim("s"), 1, 240).alias("snippet"))
    return rows if limit is None else rows.orderBy("file", "line", "column").limit(min(limit, 200_000))


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows with ``truncated``, told by one row more that is read but not returned; one pass."""
    probe = rows.limit(limit + 1).withColumn("_k", F.monotonically_increasing_id())  # at most limit + 1 rows
    w = Window.orderBy("_k")
    told = probe.withColumn("_n", F.row_number().over(w)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit)
    return told.where(F.col("_n") <= limit).drop("_k", "_n")


def workspace_symbols(symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """(id, name, file, rank): 1 exact, 2 ignoring case, 3 prefix, 4 all words, 5 within, 6 no query."""
    low, name = query.lower(), F.lower("name")
    tokens = query_terms(query)
    every = F.lit(bool(tokens))
    for t in tokens:
        every = every & F.contains(normalized(F.col("name")), F.lit(t))
    rank = F.lit(6) if not query else F.when(F.col("name") == query, 1).when(name == low, 2).when(name.startswith(low), 3).when(every, 4).when(F.contains(name, F.lit(low)), 5)
    rows = symbols.select("id", "name", "file", "exported", rank.alias("rank")).where("rank is not null")
    return rows.orderBy("rank", F.desc("exported"), "file", "id").limit(min(limit, 500)).select("id", "name", "file", "rank")


def trigrams(chunks: DataFrame) -> DataFrame:
    """(tri, id): postings of the normalised text without blanks, one for each text and trigram."""
    close = F.explode(F.array(compact(normalized(F.col("text"))))).alias("t")
    # a look-ahead steps through the text once; substrings by index would start over each time
    tris = F.array_distinct(F.regexp_extract_all("t", F.lit("(?s)(?=(...))"), F.lit(1)))
    return chunks.select("id", close).select(F.explode(tris).alias("tri"), "id")


def trigram_lookup(postings: DataFrame, term: str) -> DataFrame:
    """Ids whose text holds every trigram of ``term`` (a superset of those that hold the term)."""
    tris = sorted({term[i : i + 3] for i in range(len(term) - 2)})
    return postings.where(F.col("tri").isin(*tris)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(tris)).select("id")


# --- candidates, snippets, boosts --------------------------------------------------------------

# Boosts of documents, and the bounds of retrieval.
PHRASE_BOOST, PROXIMITY_BOOST = 18, 6
PREFETCH, CANDIDATES = 8000, 2000


def term_matches(norm: Column, terms: Sequence[str]) -> tuple[Column, Column, Column]:
    """How many terms a normalised text holds, whether it holds them as a phrase, and else in order."""
    n = F.lit(0)
    for t in terms:
        n = n + F.contains(compact(norm), F.lit(t)).cast("int")
    every = (n == len(terms)) if len(terms) > 1 else F.lit(False)
    phrase = every & F.contains(norm, F.lit(" ".join(terms)))
    near = every & ~phrase & norm.rlike(".*".join(re.escape(t) for t in terms))
    return n, phrase, near


def chunk_candidates(chunks: DataFrame, query: str, prefetch: int = PREFETCH, limit: int = CANDIDATES) -> DataFrame:
    """(id, file, ordinal, score, phrase, proximity, matched): candidates in their order.

    Retrieval takes, up to ``prefetch`` texts, those that hold the phrase, then
    those that hold all terms, then each term's, a share of the bound for each, by
    path and ordinal; of these the ``limit`` best by score, phrase, proximity,
    number of terms, path and ordinal are returned.
    """
    terms = query_terms(query)
    rows = chunks.select("id", "file", "ordinal", F.explode(F.array(normalized(F.col("text")))).alias("norm"))
    n, phrase, near = term_matches(F.col("norm"), terms)
    score = field_score(F.col("norm"), terms)
    each = [F.contains(compact(F.col("norm")), F.lit(t)) for t in terms]
    rows = rows.select("id", "file", "ordinal", score.alias("score"), phrase.alias("phrase"), near.alias("proximity"), n.alias("matched"), F.array(*each).alias("each")).where("matched > 0")
    rows = materialise(rows, "candidates")
    order = ["file", "ordinal", "id"]
    taken = rows.where("phrase").orderBy(*order).limit(prefetch) if len(terms) > 1 else rows.limit(0)
    every = rows.where(F.col("matched") == len(terms)).orderBy(*order).limit(prefetch)
    quota = -(-prefetch // max(1, len(terms)))
    for k in range(len(terms) if len(terms) > 1 else 0):
        taken = taken.unionByName(rows.where(F.col("each")[k]).orderBy(*order).limit(quota))
    taken = taken.unionByName(every).drop("each").distinct()
    return taken.orderBy(F.desc("score"), F.desc("phrase"), F.desc("proximity"), F.desc("matched"), *order).limit(limit)


def docs_boost(path: Column, norm: Column, terms: Sequence[str], identifier: bool = False) -> Column:
    """What a document's text score gains from a phrase or from terms in order; nothing if the query looks like an identifier."""
    _, phrase, near = term_matches(norm, terms)
    document = surface(path) == "docs"
    return F.when(document & phrase & F.lit(not identifier), PHRASE_BOOST).when(document & near & F.lit(not identifier), PROXIMITY_BOOST).otherwise(0)


def snippets(chunks: DataFrame, query: str) -> DataFrame:
    """(id, line, snippet): the first line that scores (else the first), with one line before and after it; lines count from 1."""
    terms = query_terms(query)
    # a line scores only by a term that stands in it without blanks, so in the whole text without them: other texts' lines aren't scored
    same = lambda t: t.replace("\u03c2", "\u03c3")  # noqa: E731  # a sigma's form depends on where a word ends
    whole = F.replace(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\p{M}_]+", ""), F.lit("\u03c2"), F.lit("\u03c3"))
    lines = chunks.select("id", F.split("text", r"\r?\n").alias("lines"), F.explode(F.array(whole)).alias("whole"))
    near = reduce(or_, [F.contains(F.col("whole"), F.lit(same(t))) for t in terms], F.lit(False))
    hit = lambda x: field_score(normalized(x), terms) > 0
    first = F.when(near, F.array_position(F.transform("lines", hit), F.lit(True)).cast("int"))
    rows = lines.select("id", "lines", F.explode(F.array(F.greatest(first, F.lit(1)))).alias("line"))
    top = F.greatest(F.col("line") - 1, F.lit(1))
    shown = F.array_join(F.slice("lines", top, F.col("line") + 1 - top + 1), "\n")
    return rows.select("id", "line", F.regexp_replace(shown, r"^\s+|\s+$", "").alias("snippet"))


def search_sql_objects(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, name, file, score) of tables, views, indexes and routines: 4 * name + file + docstring."""
    terms = query_terms(query)
    part = lambda c: field_score(normalized(F.coalesce(c, F.lit(""))), terms)
    rows = symbols.where(F.col("kind").isin("table", "view", "index", "routine")).select("id", "name", "file", (4 * part("name") + part("file") + part("docstring")).alias("score"))
    return rows.where("score > 0").orderBy(F.desc("score"), "file", "id").limit(limit)


def explored(symbols: DataFrame, files: DataFrame, chunks: DataFrame, edges: DataFrame, query: str, is_test, limit: int = 10) -> DataFrame:
    """(section, name, value): the best files of a query, the files they import and are imported by, and the tests among the latter."""
    top = materialise(search_hybrid(symbols, files, chunks, query, limit), "explored").select(F.col("handle").alias("file"), "score")
    inner = edges.where("to_type = 'file'").select("from_path", "to_path").distinct()
    near = lambda a, b: inner.join(top.select(F.col("file").alias(a)), a, "left_semi").groupBy(F.col(b).alias("file")).agg(F.count("*").cast("long").alias("score"))
    deps, users = near("from_path", "to_path"), materialise(near("to_path", "from_path"), "explored")
    part = lambda t, name: t.select(F.lit(name).alias("section"), F.col("file").alias("name"), F.col("score").cast("long").alias("value"))
    best = lambda t: t.orderBy(F.desc("score"), "file").limit(limit)
    return part(top, "result").unionByName(part(best(deps), "dependency")).unionByName(part(best(users.where(~is_test(F.col("file")))), "importer")).unionByName(part(best(users.where(is_test(F.col("file")))), "test"))


def bounded_lists(rows: DataFrame, bounds: dict[str, int]) -> DataFrame:
    """``rows`` whose array columns hold at most so many items, with <name>_omitted beside them."""
    out = rows
    for name, most in bounds.items():
        out = out.withColumn(f"{name}_omitted", F.greatest(F.size(name) - most, F.lit(0))).withColumn(name, F.slice(name, 1, most))
    return out


def first_seen(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, by ``order``: a partial minimum, so a frequent key doesn't meet in one task."""
    rest = [c for c in rows.columns if c not in keys]
    lead = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], *[F.col(c) for c in rest])
    return rows.groupBy(*keys).agg(F.min(lead).alias("_m")).select(*[F.col(c) if c in keys else F.col(f"_m.{c}") for c in rows.columns])
