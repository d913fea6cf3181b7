from pyspark.sql import functions as F

from tessera.operators import chunking, reports
from tessera.sources import export, extract, scan
from tessera.streaming import windows


def test_scan_and_refresh(spark, tmp_path):
    for name, text in (("src/a.ts", "import './b'"), ("src/b.ts", "x"), ("node_modules/c.ts", "y"), ("readme.md", "z")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    now = scan.scan_files(spark, str(tmp_path), ["**/*.ts"])
    assert {r.path: r.text for r in now.collect()} == {"src/a.ts": "import './b'", "src/b.ts": "x"}
    old = spark.createDataFrame([("src/a.ts", "other"), ("gone.ts", "s")], "path string, signature string")
    plan = scan.refresh_plan(now, old)
    assert {r.path: r.change for r in plan.collect()} == {"src/a.ts": "modified", "src/b.ts": "added", "gone.ts": "deleted"}
    facts = spark.createDataFrame([("src/a.ts", 1), ("gone.ts", 2), ("kept.ts", 3)], "path string, n int")
    new = spark.createDataFrame([("src/a.ts", 9)], "path string, n int")
    assert {tuple(r) for r in scan.refreshed(facts, new, plan).collect()} == {("kept.ts", 3), ("src/a.ts", 9)}


def test_resolution_goes_through_all_places(spark):
    known = ["src/app/view.ts", "lib/core/index.ts", "packages/ui/src/index.ts", "packages/ui/button.ts", "a/b/c.py", "src/node_modules/dep/index.js", "node_modules/dep/x.js", "vendor/odd.ts", "x.ts", "deep.ts"]
    files = spark.createDataFrame([(f,) for f in known], "path string")
    asks = {"@/view": "src/app/view.ts", "@core": "lib/core/index.ts", "ui/button": "packages/ui/button.ts", "ui/src": "packages/ui/src/index.ts", "a.b.c": "a/b/c.py", "dep": "src/node_modules/dep/index.js", "dep/x": "node_modules/dep/x.js", "odd": "vendor/odd.ts", "../../x": "x.ts", "/x": "x.ts", "none": None, "../../../x": None, "./a/b/c/d/e/../../../../../../../deep": "deep.ts"}
    imports = spark.createDataFrame([("src/app/m.ts", s) for s in asks], "path string, specifier string")
    packages = spark.createDataFrame([("ui", "packages/ui")], "name string, folder string")
    found = extract.resolve_imports(imports, files, paths={"@/*": ["missing/*", "src/app/*"], "@core": ["lib/core"]}, packages=packages, path_like=True, node_modules=True, hints=["vendor"])
    assert {r.specifier: r.to_path if r.to_type == "file" else None for r in found.collect()} == asks


def test_imports_and_resolution(spark):
    text = 'import a from "./x";\nimport "side";\nexport { q } from "../up/y";\nconst z = require("fs"); import("./lazy");\n'
    files = spark.createDataFrame([("src/m.ts", text)], "path string, text string")
    found = extract.import_specifiers(files)
    assert [r.specifier for r in found.orderBy("ordinal").collect()] == ["./x", "side", "../up/y", "fs", "./lazy"]
    known = spark.createDataFrame([("src/x.ts",), ("src/x/index.ts",), ("up/y/index.js",)], "path string")
    got = {r.specifier: (r.to_path, r.to_type) for r in extract.resolve_imports(found, known).collect()}
    assert got == {"./x": ("src/x.ts", "file"), "side": ("side", "external"), "../up/y": ("up/y/index.js", "file"), "fs": ("fs", "external"), "./lazy": ("./lazy", "external")}
    packages = spark.createDataFrame([("side",)], "name string")
    kinds = {r.specifier: r["class"] for r in extract.classify_external(found, packages).collect()}
    assert kinds["fs"] == "stdlib" and kinds["side"] == "package" and kinds["./lazy"] == "unresolved"
    py = spark.createDataFrame([("p.py", "import os\nfrom .a import b\n  import c.d as e\n")], "path string, text string")
    assert [r.specifier for r in extract.import_specifiers(py, "py").orderBy("ordinal").collect()] == ["os", ".a", "c.d"]


def test_markdown_links(spark):
    text = "[a](x.md#f) ![i](p.png) `[code](no.md)` <https://e.org> [t][Ref] [u][gone]\n\n[ref]: y.md\n```\n[in](fence.md)\n```\n"
    got = {(r.kind, r.destination, r.missing_reference) for r in extract.markdown_links(spark.createDataFrame([("r.md", text)], "path string, text string")).collect()}
    assert got == {("inline", "x.md#f", False), ("autolink", "https://e.org", False), ("reference", "y.md", False), ("reference", None, True)}


def test_sql_facts():
    text = """-- create table no
CREATE TABLE IF NOT EXISTS App.Users (id int REFERENCES "Org");
CREATE UNIQUE INDEX ix ON users (id);
WITH c AS (SELECT * FROM users) SELECT * FROM c JOIN orders o ON 1 = 1;
INSERT INTO log SELECT 'from x' FROM users
GO
DROP VIEW v; DELETE FROM log; ALTER TABLE t ADD x int"""
    got = [(a, k, n, r) for a, _, k, n, r in extract.facts_of(text)]
    assert got == [(2, "defines_table", "app.users", None), (2, "references", "Org", "app.users"), (3, "defines_index", "ix", "users"), (4, "reads", "users", None), (4, "joins", "orders", None), (5, "writes", "log", None), (5, "reads", "users", "log"), (7, "drops", "v", None), (7, "writes", "log", None), (7, "alters", "t", None)]


def test_lineage_by_full_or_unique_base_name(spark):
    rows = [("a", "defines_table", "app.users"), ("b", "defines_table", "x.dup"), ("c", "defines_table", "y.dup"), ("q", "reads", "app.users"), ("q", "reads", "users"), ("q", "joins", "dup")]
    facts = spark.createDataFrame(rows, "path string, kind string, object_name string")
    assert {(r.object_name, r.defined_in) for r in extract.sql_lineage(facts).collect()} == {("app.users", "a"), ("users", "a"), ("dup", None)}


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,3 +1,3 @@
 keep
-old
+new
 tail
@@ -10,2 +10,1 @@ def f
-gone
 last
diff --git a/n.py b/n.py
new file mode 100644
--- /dev/null
+++ b/n.py
@@ -0,0 +1,1 @@
+hello
diff --git a/o.py b/m.py
rename from o.py
rename to m.py
diff --git a/b.bin b/b.bin
Binary files a/b.bin and b/b.bin differ
"""


def test_diff(spark):
    rows = [tuple(r)[1:] for r in extract.parse_diff(spark.createDataFrame([(1, DIFF), (2, None)], "id int, text string")).collect()]
    assert [r[7] for r in rows] == [None, 2, 2, None, 10, None, 1, None]
    got = [r[:7] for r in rows]
    assert got == [
        ("x.py", None, "modified", 1, " ", 1, 1), ("x.py", None, "modified", 1, "-", 2, 0), ("x.py", None, "modified", 1, "+", 0, 2), ("x.py", None, "modified", 1, " ", 3, 3),
        ("x.py", None, "modified", 2, "-", 10, 0), ("x.py", None, "modified", 2, " ", 11, 10), ("n.py", None, "added", 1, "+", 0, 1), ("b.bin", None, "binary", 0, " ", 0, 0),
    ]
    symbols = spark.createDataFrame([("x.py", "outer", 1, 300), ("x.py", "inner", 2, 3)], "file string, id string, start int, end int")
    lines = spark.createDataFrame([("x.py", 2), ("x.py", 150), ("x.py", 400)], "file string, line int")
    assert {(r.line, r.id) for r in reports.changed_symbols(lines, symbols).collect()} == {(2, "inner"), (150, "outer")}


def test_chunks_cover_every_line():
    text = "a b c\n\nd " + "x " * 25 + "\nlast"
    parts = list(chunking.packed_lines(text, 10))
    assert all(n <= 10 for *_, n in parts) and " ".join(t for _, _, t, _ in parts).split() == text.split()
    assert parts[0][:3] == (1, 2, "a b c\n") and parts[-1][:2] == (4, 4)


def test_bundle_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("a",), ('q"',)], "path string")
    edges = spark.createDataFrame([("a", 'q"')], "from_path string, to_path string")
    export.write_tables({"files": files, "edges": edges}, str(tmp_path / "b"))
    back = export.read_tables(spark, str(tmp_path / "b"))
    assert {k: sorted(map(tuple, v.collect())) for k, v in back.items()} == {"files": [("a",), ('q"',)], "edges": [("a", 'q"')]}
    assert '  "a" -> "q\\"";' in {r.line for r in export.dot_lines(edges).collect()}
    assert any("#quot;" in r.line for r in export.mermaid_lines(edges).collect())


def test_change_stream_folds_into_versions(spark, tmp_path):
    schema = "path string, n int, kind string, version long"
    for k, rows in enumerate(([("a", 1, "added", 1), ("b", 1, "added", 1)], [("a", 2, "modified", 2), ("a", 3, "modified", 3), ("b", 0, "deleted", 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        windows.follow(stream, str(tmp_path / "out"), checkpoint=str(tmp_path / "ck")).awaitTermination()
        got = {tuple(r) for r in windows.followed(spark, str(tmp_path / "out"), k).collect()}
        assert got == {tuple(r) for r in windows.followed(spark, str(tmp_path / "out")).collect()}
        assert got == ({("a", 1), ("b", 1)} if k == 0 else {("a", 3)})


def test_event_windows_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02}:00", "view", float(m)) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "e"))
    stream = windows.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "10 minutes")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windows.tumbling(df, "10 minutes").collect()))


def test_gaps_of_blocks_beyond_the_end(spark):
    """What comes after the file's end makes no gap before it; closing rows are there even where nothing is left."""
    blocks = spark.createDataFrame([("f", 3, 5, "block"), ("f", 8, 9, "block"), ("g", 1, 10, "block"), ("h", 4, 6, "block"), ("h", 14, 16, "block")], "file string, start long, end long, kind string")
    sizes = spark.createDataFrame([("f", 10), ("g", 10), ("h", 10), ("e", 10)], "file string, end long")
    gaps = lambda **k: {(r.file, r.start, r.end) for r in chunking.filled_gaps(blocks, sizes, **k).where("kind = 'misc'").collect()}
    inside = {("f", 1, 2), ("f", 6, 7), ("f", 10, 10), ("h", 1, 3), ("h", 7, 13), ("e", 1, 10)}
    assert gaps() == inside and gaps(closing=True) == inside | {("g", 11, 10), ("h", 17, 10)}
