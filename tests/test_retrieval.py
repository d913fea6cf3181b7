import pytest
from pyspark.sql import functions as F

from tessera.operators import review as rv
from tessera.operators import search as s
from tessera.sources import export
from tessera.streaming import windows as w

CHUNK = "id string, file string, ordinal long, text string"


def test_candidates_by_passes_and_order(spark):
    rows = [("a", "z.md", 1, "alpha beta"), ("b", "b.md", 1, "beta x alpha"), ("c", "a.md", 1, "alpha only"), ("d", "a.md", 2, "Beta."), ("e", "c.md", 1, "nothing"), ("f", "c.md", 2, "alpha y beta"), ("g", "c.md", 3, None or "alphabeta")]
    chunks = spark.createDataFrame(rows, CHUNK)
    got = [(r.id, r.phrase, r.proximity, r.matched) for r in s.chunk_candidates(chunks, "alpha beta").collect()]
    assert got == [("a", True, False, 2), ("f", False, True, 2), ("g", False, True, 2), ("b", False, False, 2), ("c", False, False, 1), ("d", False, False, 1)]
    assert [r.id for r in s.chunk_candidates(chunks, "alpha beta", prefetch=1, limit=10).collect()] == ["a", "b", "c", "d"]  # one for the phrase, one for all terms, one a term


def test_snippets_and_boosts(spark):
    chunks = spark.createDataFrame([("a", "one\n two match\nthree\nfour"), ("b", "match\nnext"), ("c", "none\nhere\nx"), ("d", "")], "id string, text string")
    assert {r.id: (r.line, r.snippet) for r in s.snippets(chunks, "match").collect()} == {"a": (2, "one\n two match\nthree"), "b": (1, "match\nnext"), "c": (1, "none\nhere"), "d": (1, "")}
    rows = spark.createDataFrame([("a.md", "x y z"), ("a.md", "x z y"), ("a.md", "y x"), ("a.ts", "x y")], "p string, n string")
    assert [r.b for r in rows.select(s.docs_boost(F.col("p"), F.col("n"), ["x", "y"]).alias("b")).collect()] == [18, 6, 0, 0]


def test_bounds(spark):
    one = s.bounded(spark.range(5), 3)
    assert [r.truncated for r in one.collect()] == [True] * 3 and [r.truncated for r in s.bounded(spark.range(3), 3).collect()] == [False] * 3
    row = s.bounded_lists(spark.createDataFrame([([1, 2, 3],)], "x array<int>"), {"x": 2}).first()
    assert (row.x, row.x_omitted) == ([1, 2], 1)
    rows = spark.createDataFrame([("k", 2, "late"), ("k", 1, "first"), ("m", 5, None)], "key string, seq int, v string")
    assert {(r.key, r.v) for r in s.first_seen(rows, ["key"], ["seq"]).collect()} == {("k", "first"), ("m", None)}


def test_pairs_and_scopes(spark):
    side = lambda *v: spark.createDataFrame([("h", k, x) for k, x in enumerate(v)], "h string, k int, v string")
    assert [(r.n, r.old, r.new) for r in rv.aligned(side("a", "b"), side("c"), ["h"], ["k"], "v").orderBy("n").collect()] == [(1, "a", "c"), (2, "b", None)]
    files = spark.createDataFrame([("src/a",), ("src/b",), ("lib/c",)], "path string")
    edges = spark.createDataFrame([("src/a", "src/b", "file"), ("src/a", "lib/c", "file"), ("src/b", "react", "external"), ("lib/c", "vue", "external")], "from_path string, to_path string, to_type string")
    kept, inner = rv.under_roots(files, edges, ["src"])
    assert {r.path for r in kept.collect()} == {"src/a", "src/b"} and {(r.from_path, r.to_path) for r in inner.collect()} == {("src/a", "src/b"), ("src/b", "react")}
    symbols = spark.createDataFrame([("1", "class", "f", "C", True), ("2", "function", "f", "hidden", False)], "id string, kind string, file string, name string, exported boolean")
    imports = spark.createDataFrame([("g", "X", "f", "C"), ("g", "Y", "f", "hidden")], "file string, alias string, target_file string, target_name string")
    nodes, links = rv.symbol_graph(symbols, imports)
    assert nodes.count() == 4 and [(r.from_id, r.to_id) for r in links.collect()] == [("g#X", "1")]


def test_streamed_grep_equals_the_batch(spark, tmp_path):
    rows = [(k, "has match" * (k % 3)) for k in range(60)]
    spark.createDataFrame(rows, "id long, text string").repartition(5).write.parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    live = w.drained(w.matching(w.source(spark, f"{tmp_path}/in", table.schema, 1), "match", "text", "id"), f"{tmp_path}/out", f"{tmp_path}/check")
    assert {tuple(r) for r in live.collect()} == {tuple(r) for r in w.matching(table, "match", "text", "id").collect()} == {(k, k % 3) for k in range(60) if k % 3}
    manifest = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, signature string")
    sessions = spark.createDataFrame([("s", "a", "1"), ("s", "b", "old"), ("s", "gone", "3"), ("t", "a", "1")], "session string, path string, signature string")
    assert {tuple(r) for r in w.freshness(manifest, sessions).collect()} == {("s", 2, 3), ("t", 0, 1)}


def test_graph_json_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("a", "ts"), ("b", "py")], "path string, language string")
    edges = spark.createDataFrame([("a", "b", "file", "./b", False, "precise", 0.5, 1)], "from_path string, to_path string, to_type string, raw string, type_only boolean, resolved string, confidence double, seq long")
    export.json_lines(files, edges).write.text(f"{tmp_path}/g")
    nodes, links = export.read_json_lines(spark, f"{tmp_path}/g")
    assert {tuple(r) for r in nodes.collect()} == {("a", "ts"), ("b", "py")} and [tuple(r) for r in links.collect()] == [tuple(r) for r in edges.collect()]
    assert export.compact_json(files, edges).first().value == '{"files":["a","b"],"edges":[[0,1]]}'


def test_sql_objects(spark):
    rows = spark.createDataFrame([("1", "orders", "db/x.sql", None, "table"), ("2", "orders", "db/y.sql", None, "function"), ("3", "other", "db/orders.sql", "all orders", "view")], "id string, name string, file string, docstring string, kind string")
    assert [(r.id, r.score) for r in s.search_sql_objects(rows, "orders").collect()] == [("1", 40), ("3", 20)]


@pytest.mark.parametrize("kind", ["function", "class"])
def test_enclosing_callable(spark, kind):
    symbols = spark.createDataFrame([("out", "f", "function", 1, 100), ("in", "f", kind, 10, 20)], "id string, file string, kind string, start long, end long")
    places = spark.createDataFrame([("f", 15), ("f", 50), ("f", 200)], "file string, line long")
    assert {r.line: r.id for r in rv.enclosing_callable(places, symbols).collect()} == {15: "in" if kind == "function" else "out", 50: "out"}


def test_scope_of_many_roots(spark, tmp_path):
    """More roots than a caller types: as a table, each with the files below it."""
    from tessera.plans import queries

    n = 1500  # all named s1...
    spark.range(n).select((F.col("id") + 10_000).alias("s_suppkey"), F.lit(1).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "Brand#1")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    line = lambda k, supp, flag: (k, 1, supp, 1, 1.0, 1.0, 0.0, 0.0, flag, "F", None)
    rows = [line(k, 10_000 + (k + x) % n, "A") for k in range(n) for x in (0, 1)] + [(*line(n, 20_000, "A")[:3], 2, *line(n, 20_000, "A")[4:]), line(n, 10_000, "A")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert queries.QUERIES["scoped_graph"](spark, str(tmp_path)).count() == n
    files = spark.createDataFrame([("src/a/x",), ("src/ab",), ("src/a",), ("/lib/y",)], "path string")
    edges = spark.createDataFrame([], "from_path string, to_path string, to_type string")
    for roots in (["src/a/"], ["src", "src/a"], ["/"], ["none"]):
        table = spark.createDataFrame([(r,) for r in roots], "root string")
        assert sorted(rv.under_roots(files, edges, table)[0].collect()) == sorted(rv.under_roots(files, edges, roots)[0].collect())


def test_symbol_graph_of_popular_targets(spark, monkeypatch):
    """Exports of a popular target are dealt to parts; repeated symbols and ids under several targets give an edge once."""
    monkeypatch.setattr(rv, "SHARE", 3)
    rows = [(f"e{k % 20}", "class", "f", "C", True) for k in range(25)] + [("both", "class", "f", "C", True), ("both", "class", "g", "D", True)]
    symbols = spark.createDataFrame(rows, "id string, kind string, file string, name string, exported boolean")
    imports = spark.createDataFrame([(f"i{k}", "X", t, n) for k in range(4) for t, n in (("f", "C"), ("g", "D"))], "file string, alias string, target_file string, target_name string")
    got = sorted((r.from_id, r.to_id) for r in rv.symbol_graph(symbols, imports)[1].collect())
    assert got == sorted((f"i{k}#X", e) for k in range(4) for e in [*[f"e{n}" for n in range(20)], "both"])


def test_snippets_of_terms_parted_by_signs(spark):
    """The check of the whole text loses no line: terms split by signs, by case, with either sigma; it reads no line of other texts."""
    rows = [("a", "x\nlic-En sed\ny"), ("b", "lic\nensed"), ("c", "q\n\u0391\u0392\u03a3Cd z"), ("d", None)]
    chunks = spark.createDataFrame(rows, "id string, text string")
    assert {r.id: r.line for r in s.snippets(chunks, "licensed").collect()} == {"a": 2, "b": 1, "c": 1, "d": 1}
    assert {r.id: r.line for r in s.snippets(chunks, "ab\u03c2 \u03b1\u03b2\u03c2").collect()}["c"] == 2
    plan = s.snippets(chunks, "licensed")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(") == 1 and "CASE WHEN Contains(whole" in plan
