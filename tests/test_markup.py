from pyspark.sql import functions as F

from tessera.functions import textual
from tessera.operators import chunking, review
from tessera.sources import markup


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_references_of_each_kind(spark):
    text = {
        "rst": "See `the guide <guide.rst>`_ and `x <y>`__.\n.. _home: https://e.org/\n.. include:: part.txt\n",
        "adoc": "link:a.html[A] xref:b.adoc[] <<c,see>>\ninclude::d.adoc[]\n",
        "hbs": "{{> header }} {{name}} {{>nav/item}}",
        "mdx": "import X from './x'\nimport './y.css'\ntext import z",
        "css": "@import 'a.css';\n@import url(b.css);\ni { background: url( \"c.png\" ) }",
    }
    got = {k: [tuple(r)[1:] for r in markup.references(files(spark, ("f", t), ("g", None)), k).collect()] for k, t in text.items()}
    assert got["rst"] == [("link", "guide.rst"), ("link", "y"), ("target", "https://e.org/"), ("include", "part.txt")]
    assert got["adoc"] == [("link", "a.html"), ("xref", "b.adoc"), ("xref", "c"), ("include", "d.adoc")]
    assert got["hbs"] == [("partial", "header"), ("partial", "nav/item")]
    assert got["mdx"] == [("import", "./x"), ("import", "./y.css")]
    assert got["css"] == [("import", "a.css"), ("import", "b.css"), ("url", "c.png")]


def test_component_regions(spark):
    text = "<template>\n<p/>\n</template>\n\n<script lang=\"ts\">let a</script>\n<style scoped>p{}</style>"
    got = [tuple(r)[1:] for r in markup.component_regions(files(spark, ("c.vue", text), ("d", None))).collect()]
    assert got == [(0, "template", "", 1, "\n<p/>\n"), (1, "script", 'lang="ts"', 5, "let a"), (2, "style", "scoped", 6, "p{}")]


def test_manifests_places_handles_sensitive(spark):
    rows = [("a/package.json", '{"name": "web"}'), ("Cargo.toml", '[package]\nname = "core"\n'), ("go.mod", "module e.org/x\n"), ("pyproject.toml", "[tool]\n"), ("x.txt", "name = a"), ("b/package.json", None)]
    assert {tuple(r) for r in markup.manifest_names(files(spark, *rows)).collect()} == {("a/package.json", "web"), ("Cargo.toml", "core"), ("go.mod", "e.org/x")}
    p = spark.createDataFrame([("a/b.ts:3:4",), ("c:9",), ("none",), (None,)], "t string").select(markup.place(F.col("t")).alias("p")).collect()
    assert [tuple(r.p) if r.p else None for r in p] == [("a/b.ts", 3, 4), ("c", 9, None), None, None]
    h = spark.range(1).select(markup.handle(F.lit("symbol"), F.lit("a:b%"), F.lit(3)).alias("h")).withColumn("p", markup.handle_parts(F.col("h"))).first()
    assert h.h == "symbol:a%3Ab%25:3" and h.p == ["symbol", "a:b%", "3"]
    paths = {"x/.env": True, ".env.local": True, "k/server.PEM": True, "id_rsa": True, "src/env.ts": False, "keys.md": False}
    got = spark.createDataFrame([(k,) for k in paths], "p string").select("p", textual.is_sensitive(F.col("p")).alias("s")).collect()
    assert {r.p: r.s for r in got} == paths


def test_small_chunks_merge(spark):
    rows = [("f", 1, 2, "a", None, 5), ("f", 3, 4, "b", "n", 5), ("f", 5, 9, "c", "m", 50), ("f", 10, 11, "d", None, 3), ("f", 13, 14, "e", None, 3), ("g", 1, 1, "z", "z", 1)]
    got = [tuple(r) for r in chunking.merged_small(spark.createDataFrame(rows, "file string, start int, end int, kind string, name string, tokens int"), 8, 40).orderBy("file", "start").collect()]
    assert got == [("f", 1, 4, "a+b", "n", 10), ("f", 5, 9, "c", "m", 50), ("f", 10, 11, "d", None, 3), ("f", 13, 14, "e", None, 3), ("g", 1, 1, "z", "z", 1)]


def test_breaking_and_untested(spark):
    s = lambda rows: spark.createDataFrame(rows, "id string, kind string, exported boolean")
    base, head = s([("a", "f", True), ("b", "f", True), ("c", "f", True), ("d", "f", True), ("e", "f", False)]), s([("b", "f", False), ("c", "g", True), ("d", "f", True)])
    e = spark.createDataFrame([("x", "a"), ("y", "a"), ("a", "a")], "from_id string, to_id string")
    assert {tuple(r) for r in review.breaking_changes(base, head, e).collect()} == {("a", "removed", 2), ("b", "hidden", 0), ("c", "kind", 0)}
    edges = spark.createDataFrame([("t_test.go", "a", "file", "r"), ("b", "c", "file", "r")], "from_path string, to_path string, to_type string, raw string")
    changed = spark.createDataFrame([("a",), ("c",), ("t_test.go",)], "file string")
    assert [r.file for r in review.untested_changes(edges, changed, textual.is_test_file).collect()] == ["c"]
    assert [tuple(r) for r in review.deleted_importers(edges, spark.createDataFrame([("c",)], "file string")).collect()] == [("c", "b", "r")]
