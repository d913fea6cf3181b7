import pytest
from pyspark.sql import functions as F

from tessera.functions import textual as t
from tessera.functions.languages import parse_question, parse_symbol_query
from tessera.operators import canned, search


@pytest.mark.parametrize(("raw", "want"), [("parseHTTPRequest", "parse http request"), ("snake_case", "snake_case"), ("Émile2Zola", "émile2 zola"), ("a.b/c-d", "a b c d"), ("", "")])
def test_normalised(spark, raw, want):
    assert spark.range(1).select(t.normalized(F.lit(raw)).alias("x")).first().x == want


@pytest.mark.parametrize(("text", "terms", "want"), [("build report", ["build"], 10), ("rebuild", ["build"], 4 + 3), ("buil d", ["build"], 7), ("build the report", ["build", "report"], 10 + 10 + 12 + 10), ("build report", ["build", "report"], 62), ("report build", ["build", "report"], 32), ("none", ["build"], 0)])
def test_field_score(spark, text, terms, want):
    assert spark.range(1).select(t.field_score(F.lit(text), terms).alias("x")).first().x == want


def test_query_languages():
    q = parse_symbol_query('kind:class,function name:"two words" odd:key plain "quoted text" doc:')
    assert (q.kinds, q.name, q.doc, q.text) == (["class", "function"], "two words", "", "odd:key plain quoted text")
    assert parse_question("top 3 most called functions").limit == 3 and parse_question("most complex class").plan == "complex_class"
    with pytest.raises(ValueError, match="Unsupported"):
        parse_question("tell me a story")


def test_symbol_filter(spark):
    s = spark.createDataFrame([("1", "Foo", "class", "a.ts", None), ("2", "bar", "function", "b.ts", "does foo"), ("3", "baz", "type", "c.ts", "x")], "id string, name string, kind string, file string, docstring string")
    ids = lambda q: {r.id for r in s.where(parse_symbol_query(q).column()).collect()}
    assert ids("foo") == {"1", "2"} and ids("kind:class") == {"1"} and ids("doc:FOO") == {"2"} and ids("") == {"1", "2", "3"} and ids("name:ba file:c") == {"3"}


def test_globs_tests_surface(spark):
    import re

    assert re.match(t.glob_regex("src/**/*.{ts,js}"), "src/a/b.ts") and re.match(t.glob_regex("src/**/*.{ts,js}"), "src/b.js") and not re.match(t.glob_regex("*.ts"), "a/b.ts")
    paths = spark.createDataFrame([("tests/a.py",), ("src/a.test.ts",), ("docs/x.md",), ("src/contest.ts",), ("package.json",)], "p string")
    got = {r.p: (r.t, r.s) for r in paths.select("p", t.is_test_file(F.col("p")).alias("t"), t.surface(F.col("p")).alias("s")).collect()}
    assert got == {"tests/a.py": (True, "code"), "src/a.test.ts": (True, "code"), "docs/x.md": (False, "docs"), "src/contest.ts": (False, "code"), "package.json": (False, "config")}


def test_grep_columns_and_lines(spark):
    c = spark.createDataFrame([("f", "ab ab\r\n  xAB\n"), ("g", "none")], "file string, text string")
    rows = [tuple(r) for r in search.grep(c, "ab", ignore_case=True).collect()]
    assert rows == [("f", 1, 1, "ab", "ab ab"), ("f", 1, 4, "ab", "ab ab"), ("f", 2, 4, "AB", "xAB")]
    assert search.bounded(search.grep(c, "ab"), 1).first().truncated


def test_bounded_sql(spark):
    views = {"t": spark.range(300).select("id", F.repeat(F.lit("xé"), 4500).alias("wide"), F.lit(1).alias("set"))}
    rows = canned.bounded_sql(spark, "SELECT id, wide FROM t ORDER BY id", views, max_rows=900, max_bytes=17_000).collect()
    assert len(rows) == 2 and all(r.truncated and r.wide.endswith("...[truncated]") and 7996 <= len(r.wide.encode()) <= 8000 for r in rows)
    few = canned.bounded_sql(spark, "select id, `set`, 't and set' as s from t where id < :top", views, args={"top": 3}).collect()
    assert [(r.id, r.s, r.truncated) for r in few] == [(0, "t and set", False), (1, "t and set", False), (2, "t and set", False)]
    assert canned.bounded_sql(spark, "select id from t", views, max_rows=900).count() == 300
    assert {r.truncated for r in canned.bounded_sql(spark, "with u as (select id from t) select * from u", views, max_rows=5).collect()} == {True}
    for bad in ("DROP TABLE t", "insert into t select 1", "with u as (select 1) insert into t select * from u", "set x = 1"):
        with pytest.raises(ValueError, match="SELECT"):
            canned.bounded_sql(spark, bad, views)
    with pytest.raises(ValueError, match="no statement"):
        canned.bounded_sql(spark, "select 1; select 2", views)


def test_clipped_keeps_whole_characters(spark):
    texts = ["a" * 20, "é" * 10, "日" * 7, "😀" * 5, "a" * 15 + "😀" * 2, "short", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in range(14, 24):
        for t, r in zip(texts, df.select(canned.clipped(F.col("t"), most).alias("c")).collect(), strict=True):
            if t is None or len(t.encode()) <= most:
                assert r.c == t
            else:
                kept = next(t[:k] for k in range(len(t), -1, -1) if len(t[:k].encode()) <= most - len(canned.MARK))
                assert r.c == kept + canned.MARK


def test_deadline(spark):
    assert canned.collected(spark.range(3), 60) and True
    slow = spark.range(4).mapInPandas(lambda it: (__import__("time").sleep(20) or b for b in it), "id long")
    with pytest.raises(TimeoutError):
        canned.collected(slow, 1)


def test_hybrid_merge(spark):
    a = spark.createDataFrame([("x", 5, "path"), ("y", 3, "path")], "handle string, score long, reason string")
    b = spark.createDataFrame([("y", 4, "text")], "handle string, score long, reason string")
    assert [tuple(r) for r in search.merge_results(a, b).collect()] == [("y", 7, "path,text"), ("x", 5, "path")]
