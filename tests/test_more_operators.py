from pyspark.sql import functions as F

from tessera.operators import graphs, reports, review
from tessera.sources import extract

EDGE = "from_path string, to_path string, to_type string, resolved string"


def test_cycles_in_each_order(spark):
    pairs = [("a", "b"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("p", "a"), ("q", "a"), ("r", "b")]
    e = spark.createDataFrame([(a, b, "file", None) for a, b in pairs], EDGE)
    files = lambda mode: [r.files for r in graphs.cycles_sorted(e, mode).collect()]
    assert files("size") == ["x,y,z", "a,b"] and files("fanin") == ["a,b", "x,y,z"] == files("priority")
    assert graphs.cycles_sorted(e, "size", 1).count() == 1


def test_implementations_and_renames(spark):
    s = spark.createDataFrame([("i", "I", "f"), ("c", "C", "g"), ("d", "D", "f"), ("n", "New", "f")], "id string, name string, file string")
    e = spark.createDataFrame([("c", "i", "implements"), ("d", "c", "extends"), ("gone", "i", "implements"), ("n", "i", "calls")], "from_id string, to_id string, label string")
    assert {(r.id, r.depth, r.status) for r in graphs.implementations(e, s, "i").collect()} == {("c", 1, "resolved"), ("d", 2, "resolved"), ("gone", 1, "unresolved")}
    assert {tuple(r) for r in review.rename_preview(s, e, "i", "New").collect()} == {("definition", "i", "f"), ("reference", "c", "g"), ("reference", "n", "f"), ("conflict", "n", "f")}


def test_coverage(spark):
    files = spark.createDataFrame([("a", "ts"), ("b", "py")], "path string, language string")
    e = spark.createDataFrame([("a", "b", "file", "precise"), ("a", "c", "file", None), ("b", "x", "external", None), ("lost", "x", "file", None)], EDGE)
    assert {tuple(r) for r in reports.resolution_coverage(files, e).collect()} == {("ts", 1, 0, 1, 0), ("py", 0, 0, 0, 1)}
    text = "TN:\nSF:src/a.ts\nDA:1,2\nDA:2,0\nend_of_record\nSF:src/a.ts\nDA:1,3\nend_of_record\nDA:9,9\n"
    assert {tuple(r) for r in extract.lcov_lines(spark.createDataFrame([(text,), (None,)], "text string")).collect()} == {("src/a.ts", 1, 5), ("src/a.ts", 2, 0)}


def test_html_references(spark):
    html = '<A class="k" HREF="/x">t</a><img\n src="i.png"><p src="no"><script>a</script><form action="/go">'
    got = [tuple(r) for r in reports.html_references(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).collect()]
    assert got == [(1, "a", "href", "/x"), (1, "img", "src", "i.png")]


def test_export_summary_and_sql_graph(spark):
    s = spark.createDataFrame([("f", "b", True), ("f", "a", True), ("f", "a", True), ("f", "c", False), ("g", "z", True)], "file string, name string, exported boolean")
    assert [tuple(r) for r in review.export_summary(s, spark.createDataFrame([("f",)], "file string")).collect()] == [("f", "a,b")]
    facts = extract.sql_facts(spark.createDataFrame([("q.sql", "select 1 from A join b using (x)")], "path string, text string"))
    got = {tuple(r) for r in extract.sql_graph(facts).collect()}
    assert got == {("file:q.sql", "statement:q.sql#1", "contains"), ("statement:q.sql#1", "object:a", "reads"), ("statement:q.sql#1", "object:b", "joins")}


def test_trigrams_are_those_of_the_text(spark):
    from tessera.operators import search

    rows = spark.createDataFrame([("1", "abcabc"), ("2", "ab"), ("3", None)], "id string, text string").withColumn("text", F.coalesce("text", F.lit("")))
    assert {tuple(r) for r in search.trigrams(rows).collect()} == {("abc", "1"), ("bca", "1"), ("cab", "1")}
