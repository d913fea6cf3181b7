"""Registered queries of retrieval, alignment, scopes, bounds and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import textual
from ..operators import review, search
from ..sources import adapters as ad
from ..sources import export, pycode

from ..storage import shared_path
from ..streaming import windows
from .queries import _TESTS, _norm, _score, query

_TERMS = ["license", "under"]
_C = ad.with_ctes("chunks")
_MATCHED = " + ".join(f"contains(replace(n, ' ', ''), '{t}')::INT" for t in _TERMS)
_CAND = f"""{_C}, hit AS (SELECT id, file, ordinal, {_norm('text')} AS n FROM chunks), scored AS (SELECT id, file, ordinal, {_score('n', _TERMS)} AS score, {_MATCHED} AS matched, n FROM hit WHERE {_MATCHED} > 0),
marked AS (SELECT id, file, ordinal, score, matched = 2 AND contains(n, '{' '.join(_TERMS)}') AS phrase, matched = 2 AND NOT contains(n, '{' '.join(_TERMS)}') AND regexp_matches(n, '{'.*'.join(_TERMS)}') AS proximity, matched, contains(replace(n, ' ', ''), '{_TERMS[0]}') AS a, contains(replace(n, ' ', ''), '{_TERMS[1]}') AS b FROM scored),
taken AS (SELECT * FROM (SELECT * FROM marked WHERE phrase ORDER BY file, ordinal, id LIMIT 40) UNION SELECT * FROM (SELECT * FROM marked WHERE matched = 2 ORDER BY file, ordinal, id LIMIT 40) UNION SELECT * FROM (SELECT * FROM marked WHERE a ORDER BY file, ordinal, id LIMIT 20) UNION SELECT * FROM (SELECT * FROM marked WHERE b ORDER BY file, ordinal, id LIMIT 20))"""


@query("chunk_candidates", f"{_CAND} SELECT id, file, ordinal, score, phrase, proximity, matched FROM taken ORDER BY score DESC, phrase DESC, proximity DESC, matched DESC, file, ordinal, id LIMIT 30")
def chunk_candidates(spark, d):
    return search.chunk_candidates(ad.chunks(spark, d), "license under", 40, 30)


@query("docs_boost", f"{_C}, m AS (SELECT id, {_norm('text')} AS n FROM chunks) SELECT id, CASE WHEN contains(n, 'of the') THEN 18 WHEN contains(replace(n, ' ', ''), 'of') AND contains(replace(n, ' ', ''), 'the') AND regexp_matches(n, 'of.*the') THEN 6 ELSE 0 END AS boost FROM m")
def docs_boost(spark, d):
    rows = ad.chunks(spark, d).select("id", "file", F.explode(F.array(textual.normalized(F.col("text")))).alias("n"))
    return rows.select("id", search.docs_boost(F.col("file"), F.col("n"), ["of", "the"]).alias("boost"))


@query("snippets", f"""{_C}, l AS (SELECT id, string_split_regex(text, '\\r?\\n') AS s FROM chunks), f AS (SELECT id, s, greatest(coalesce(list_position(list_transform(s, lambda x: {_score(_norm('x'), ['licensed'])} > 0), true), 0), 1) AS pos FROM l)
SELECT id, pos::INT AS line, regexp_replace(array_to_string(s[greatest(pos - 1, 1) : pos + 1], chr(10)), '^\\s+|\\s+$', '', 'g') AS snippet FROM f""")
def snippets(spark, d):
    return search.snippets(ad.chunks(spark, d), "licensed")


_OBJ = "objs AS (SELECT 'o' || p_partkey AS id, p_name AS name, 'db/' || p_brand || '.sql' AS file, 'made ' || p_type AS docstring, CASE p_size % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'view' WHEN 2 THEN 'index' WHEN 3 THEN 'routine' ELSE 'function' END AS kind FROM part)"


@query("search_sql", f"WITH {_OBJ}, s AS (SELECT id, name, file, 4 * {_score(_norm('name'), ['red', 'plate'])} + {_score(_norm('file'), ['red', 'plate'])} + {_score(_norm('docstring'), ['red', 'plate'])} AS score FROM objs WHERE kind <> 'function') SELECT * FROM s WHERE score > 0 ORDER BY score DESC, file, id LIMIT 20")
def search_sql(spark, d):
    p = ad.table(spark, d, "part")
    m = F.col("p_size") % 5
    kind = F.when(m == 0, "table").when(m == 1, "view").when(m == 2, "index").when(m == 3, "routine").otherwise("function")
    rows = p.select(F.concat(F.lit("o"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("db/"), "p_brand", F.lit(".sql")).alias("file"), F.concat(F.lit("made "), "p_type").alias("docstring"), kind.alias("kind"))
    return search.search_sql_objects(rows, "red plate")


@query("explore")
def explore(spark, d):
    return search.explored(ad.symbols(spark, d), ad.files(spark, d), ad.chunks(spark, d), ad.file_edges(spark, d), "red plate", lambda p: textual.is_test_file(p, [_TESTS]))


@query("bounded_lists", f"""{ad.with_ctes("file_edges")}, g AS (SELECT from_path AS file, list_sort(list(DISTINCT to_path)) AS targets FROM file_edges GROUP BY 1) SELECT file, array_to_string(targets[1:12], ',') AS targets, greatest(len(targets) - 12, 0)::INT AS targets_omitted FROM g""")
def bounded_lists(spark, d):
    rows = ad.file_edges(spark, d).groupBy(F.col("from_path").alias("file")).agg(F.sort_array(F.collect_set("to_path")).alias("targets"))
    return search.bounded_lists(rows, {"targets": 12}).select("file", F.array_join("targets", ",").alias("targets"), "targets_omitted")


@query("first_seen", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_seen(spark, d):
    return search.first_seen(ad.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


_ALIGNED = "{t} AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity) AS n FROM lineitem WHERE l_returnflag = '{f}')"


@query("aligned", f"WITH {_ALIGNED.format(t='a', f='A')}, {_ALIGNED.format(t='b', f='R')} SELECT l_orderkey, n::INT AS n, a.l_partkey AS old, b.l_partkey AS new FROM a FULL OUTER JOIN b USING (l_orderkey, n)")
def aligned(spark, d):
    li = ad.table(spark, d, "lineitem")
    return review.aligned(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_quantity"], "l_partkey")


_RANGES = "syms AS (SELECT 'p' || p_partkey AS id, 'src/s' || (p_partkey % 10 + 1) || '.ts' AS file, CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS kind, p_partkey % 500 AS start, p_partkey % 500 + p_size AS \"end\" FROM part)"


@query("enclosing_callable", f"""WITH {_RANGES}, pl AS (SELECT DISTINCT 'src/s' || (l_suppkey % 10 + 1) || '.ts' AS file, l_partkey % 520 AS line FROM lineitem)
SELECT pl.file, line, arg_min(id, ("end" - start, id)) AS id FROM pl JOIN syms s ON s.file = pl.file AND line BETWEEN start AND "end" WHERE kind <> 'class' GROUP BY 1, 2""")
def enclosing_callable(spark, d):
    p, li = ad.table(spark, d, "part"), ad.table(spark, d, "lineitem")
    file = lambda k: F.concat(F.lit("src/s"), (F.col(k) % 10 + 1).cast("string"), F.lit(".ts"))
    kind = F.when(F.col("p_size") % 3 == 0, "function").when(F.col("p_size") % 3 == 1, "method").otherwise("class")
    start = F.col("p_partkey") % 500
    syms = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), file("p_partkey").alias("file"), kind.alias("kind"), start.alias("start"), (start + F.col("p_size")).alias("end"))
    return review.enclosing_callable(li.select(file("l_suppkey").alias("file"), (F.col("l_partkey") % 520).alias("line")).distinct(), syms)


@query("hinted_pairs", f"""{_C}, h AS (SELECT DISTINCT a.source || '/' || a.doc_id || '.md' AS file_a, b.source || '/' || b.doc_id || '.md' AS file_b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1), u AS (SELECT id, file, language FROM chunks)
SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM h JOIN u a ON a.file = file_a JOIN u b ON b.file = file_b AND a.language = b.language""")
def hinted_pairs(spark, d):
    docs = ad.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("file").alias("file_b"))
    return review.hinted_pairs(ad.chunks(spark, d), docs.join(after, "doc_id").select(F.col("file").alias("file_a"), "file_b").distinct())


@query("scoped_graph", f"""{ad.with_ctes("files", "file_edges")}, k AS (SELECT path FROM files WHERE regexp_matches(path, '^src/s1[0-9]*\\.ts$')) SELECT from_path, to_path, to_type, count(*) AS n FROM file_edges WHERE from_path IN (SELECT path FROM k) AND (to_type <> 'file' OR to_path IN (SELECT path FROM k)) GROUP BY 1, 2, 3""")
def scoped_graph(spark, d):
    files = ad.files(spark, d)
    roots = files.where(F.col("path").rlike(r"^src/s1[0-9]*\.ts$")).select(F.col("path").alias("root"))
    _, edges = review.under_roots(files, ad.file_edges(spark, d), roots)
    return edges.groupBy("from_path", "to_path", "to_type").agg(F.count("*").alias("n"))


@query("analysis_summary", "SELECT count(*) AS files, count(*) FILTER (n_chars % 7 = 0) AS degraded, count(*) FILTER (n_chars % 7 = 1) AS skipped, count(*) FILTER (lang = 'en') AS native FROM documents")
def analysis_summary(spark, d):
    m = F.col("n_chars") % 7
    return review.analysis_summary(ad.table(spark, d, "documents").select(F.when(m == 0, "degraded").when(m == 1, "skipped").otherwise("ok").alias("status"), F.when(F.col("lang") == "en", "native").otherwise("script").alias("engine")))


_IMP = "imps AS (SELECT DISTINCT from_path AS file, 'x' || (seq % 5) AS alias, CASE WHEN to_type = 'file' THEN 'src/s' || (seq % 10 + 1) || '.ts' ELSE to_path END AS target_file, CASE seq % 3 WHEN 0 THEN 'red plate' WHEN 1 THEN 'blue bolt' ELSE 'nothing' END AS target_name FROM file_edges WHERE seq % 11 = 0)"


@query("symbol_graph", f"""{ad.with_ctes("file_edges", "symbols")}, {_IMP} SELECT 'node' AS part, id AS a, kind AS b, file AS c FROM symbols UNION ALL SELECT DISTINCT 'node', file || '#' || alias, 'alias', file FROM imps
UNION ALL SELECT DISTINCT 'edge', i.file || '#' || alias, id, 'imports' FROM imps i JOIN symbols s ON s.file = target_file AND s.name = target_name AND exported""")
def symbol_graph(spark, d):
    s = F.col("seq")
    name = F.when(s % 3 == 0, "red plate").when(s % 3 == 1, "blue bolt").otherwise("nothing")
    target = F.when(F.col("to_type") == "file", F.concat(F.lit("src/s"), (s % 10 + 1).cast("string"), F.lit(".ts"))).otherwise(F.col("to_path"))
    imports = ad.file_edges(spark, d).where("seq % 11 = 0").select(F.col("from_path").alias("file"), F.concat(F.lit("x"), (s % 5).cast("string")).alias("alias"), target.alias("target_file"), name.alias("target_name"))
    nodes, edges = review.symbol_graph(ad.symbols(spark, d), imports)
    return nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("kind").alias("b"), F.col("file").alias("c")).unionByName(edges.select(F.lit("edge").alias("part"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("label").alias("c")))


@query("stream_grep", "SELECT doc_id, len(regexp_extract_all(text, '[Ll]icensed?')) AS matches FROM documents WHERE regexp_matches(text, '[Ll]icensed?')")
def stream_grep(spark, d):
    """A table read as a stream of files, two a batch, until it is drained."""
    table = ad.table(spark, d, "documents")
    parts = shared_path(spark, "stream-in")
    table.select("doc_id", "text").repartition(6).write.parquet(parts)
    found = windows.matching(windows.source(spark, parts, spark.read.parquet(parts).schema, 2), "[Ll]icensed?", "text", "doc_id")
    return windows.drained(found, shared_path(spark, "stream-out"), shared_path(spark, "stream-checkpoint"))


@query("session_freshness", """WITH m AS (SELECT 'f' || s_suppkey AS path, md5(s_name || CASE WHEN s_suppkey % 7 = 0 THEN '!' ELSE '' END) AS now FROM supplier WHERE s_suppkey % 11 <> 0), s AS (SELECT s_suppkey % 5 AS session, 'f' || s_suppkey AS path, md5(s_name) AS signature FROM supplier)
SELECT session, count(*) FILTER (now IS NULL OR now <> signature) AS stale, count(*) AS files FROM s LEFT JOIN m USING (path) GROUP BY 1""")
def session_freshness(spark, d):
    s = ad.table(spark, d, "supplier")
    path = F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path")
    manifest = s.where("s_suppkey % 11 != 0").select(path, F.md5(F.concat("s_name", F.when(F.col("s_suppkey") % 7 == 0, "!").otherwise(""))).alias("signature"))
    return windows.freshness(manifest, s.select((F.col("s_suppkey") % 5).alias("session"), path, F.md5("s_name").alias("signature")))


@query("glob_filter", "SELECT page_id FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages) WHERE regexp_matches(path, '^(?:.*/)?[^/]*[0-9]+[^/]?$') AND (path = 'a' OR starts_with(path, 'a/') OR NOT starts_with(path, 'zz'))")
def glob_filter(spark, d):
    urls = ad.table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path"))
    digit = "{0,1,2,3,4,5,6,7,8,9}"
    fit = F.col("path").rlike(textual.glob_regex(f"**/*{digit}?")) | F.col("path").rlike(textual.glob_regex(f"**/*{digit}"))
    return urls.where(fit & (textual.under(F.col("path"), ["a/"]) | ~textual.under(F.col("path"), ["zz"]) & ~F.col("path").startswith("zz"))).select("page_id")


@query("sensitive_files", "WITH f AS (SELECT o_orderkey, (['.env', 'config/.env.local', 'keys/id_rsa', 'keys/id_rsa.pub', 'a/server.PEM', 'readme.md', 'x/.npmrc', 'monkey.ts', 'k.key'])[o_orderkey % 9 + 1] AS p FROM orders) SELECT o_orderkey FROM f WHERE lower(string_split(p, '/')[-1]) IN ('.env', '.env.local', 'id_rsa', 'server.pem', '.npmrc', 'k.key')")
def sensitive_files(spark, d):
    names = [".env", "config/.env.local", "keys/id_rsa", "keys/id_rsa.pub", "a/server.PEM", "readme.md", "x/.npmrc", "monkey.ts", "k.key"]
    o = ad.table(spark, d, "orders")
    return o.where(textual.is_sensitive(F.get(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 9).cast("int")))).select("o_orderkey")


def _python(spark, d):
    k = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("class C"), k, F.lit(":\n    def m"), k, F.lit("(self):\n        if self:\n            return help(self)\n\ndef _f"), k, F.lit("():\n    pass\nX"), k, F.lit(" = 1\n"))
    return ad.table(spark, d, "supplier").select(F.concat(F.lit("p/s"), k, F.lit(".py")).alias("path"), body.alias("text"))


_PY = "s AS (SELECT s_suppkey AS k, 'p/s' || s_suppkey || '.py' AS path FROM supplier)"


@query("py_records", f"""WITH {_PY} SELECT path, 'C' || k AS qualified, 'class' AS kind, 1 AS start, 4 AS "end", true AS exported, 2 AS complexity FROM s UNION ALL SELECT path, 'C' || k || '.m' || k, 'method', 2, 4, false, 2 FROM s
UNION ALL SELECT path, '_f' || k, 'function', 6, 7, false, 1 FROM s UNION ALL SELECT path, 'X' || k, 'variable', 8, 8, true, 1 FROM s""")
def py_records(spark, d):
    return pycode.records(_python(spark, d)).select("path", "qualified", "kind", "start", "end", "exported", "complexity")


@query("py_grep", f"WITH {_PY} SELECT path, 4 AS line, 20 AS \"column\", 'help' AS name FROM s")
def py_grep(spark, d):
    return pycode.tree_grep(_python(spark, d), "Call", "help")


@query("py_chunks", f"""WITH {_PY} SELECT path, 0 AS ordinal, 1 AS start, 5 AS "end", 'class' AS kind, 'C' || k AS name, 8 AS tokens FROM s UNION ALL SELECT path, 1, 6, 9, 'function+misc', '_f' || k, 6 FROM s""")
def py_chunks(spark, d):
    return pycode.chunk_code(_python(spark, d), 4, 30).drop("text")


@query("graph_json", """WITH f AS (SELECT list_sort(list(DISTINCT r_name)) AS files FROM region), e AS (SELECT list_sort(list(DISTINCT [a.r_name, b.r_name])) AS e FROM region a JOIN region b ON b.r_regionkey = (a.r_regionkey + 1) % 5)
SELECT '{"files":["' || array_to_string(files, '","') || '"],"edges":[' || array_to_string(list_transform(e, lambda x: '[' || (list_position(files, x[1]) - 1) || ',' || (list_position(files, x[2]) - 1) || ']'), ',') || ']}' AS value FROM f, e""")
def graph_json(spark, d):
    r = ad.table(spark, d, "region")
    a, b = r.select(F.col("r_name").alias("from_path"), ((F.col("r_regionkey") + 1) % 5).alias("k")), r.select(F.col("r_name").alias("to_path"), F.col("r_regionkey").alias("k"))
    return export.compact_json(r.select(F.col("r_name").alias("path")), a.join(b, "k").withColumn("to_type", F.lit("file")))
