import math

from pyspark.sql import functions as F

from tessera.operators import drift as dr
from tessera.operators import impact as im
from tessera.operators import reports as r
from tessera.operators import review as rv

EDGE = "from_path string, to_path string, to_type string, raw string, type_only boolean, resolved string, confidence double, seq long"


def edge(a, b, t="file", only=False):
    return (a, b, t, b, only, None, None, 0)


def test_drift_has_every_kind(spark):
    base = spark.createDataFrame([edge("a", "b"), edge("b", "c"), edge("c", "b"), edge("a", "old", "external")] + [edge(f"g{k}", "c") for k in range(12)], EDGE)
    head = spark.createDataFrame([edge("a", "b", only=True), edge("b", "a"), edge("a", "c"), edge("a", "new", "external")] + [edge(f"f{k}", "b") for k in range(12)], EDGE)
    files = spark.createDataFrame([(p,) for p in ["a", "b", "c", *[f"{x}{k}" for x in "fg" for k in range(12)]]], "path string")
    sym = lambda *n: spark.createDataFrame([(x, x, "f", "function", True) for x in n], "id string, name string, file string, kind string, exported boolean")
    groups = lambda n: spark.createDataFrame([(n,)], "groups long")
    side = lambda e, s, n: {"edges": e, "symbols": s, "duplicates": groups(n)}
    found = dr.findings(files, side(base, sym("p", "q"), 3), side(head, sym("q", "z"), 5)).cache()
    back = dr.findings(files, side(head, sym("q"), 5), side(base, sym("q"), 3))
    kinds = {x.kind for x in found.collect()} | {x.kind for x in back.collect()}
    assert kinds == set(dr.SEVERITY)
    keys = {(x.kind, x.key.replace(dr.NUL, "|")) for x in found.collect()}
    assert {("new-cycle", "a|b"), ("resolved-cycle", "b|c"), ("public-api-removal", "f#p:function"), ("unresolved-import", "a|new"), ("hotspot-jump", "b"), ("hotspot-drop", "c"), ("duplicate-increase", "duplicates:groups")} - keys == set()
    shown = dr.report(found, 3).collect()
    assert len(shown) == 3 and {x.severity for x in shown} == {"error"}
    told = {x.kind: (x.findings, x.failed) for x in dr.summary(found, ["new-cycle"]).collect()}
    assert told["new-cycle"] == (1, True) and told["hotspot-jump"] == (1, False) and told["graph-edge-type-changed"] == (1, False)
    quiet = {x.kind for x in dr.findings(files, side(base, sym("p"), 3), side(base, sym("q"), 3), edges="off", api="removals").collect()}
    assert quiet == {"public-api-removal"}


def test_severity_weighs_confidence(spark):
    one = spark.range(1)
    sure = im.confidence(F.lit("importAlias"), F.lit("low"), F.lit(1))
    r_ = one.select(sure.alias("c"), im.severity(F.lit("importAlias"), F.lit(True), F.lit(9), F.lit(False), F.lit(False), F.lit(1), sure).alias("s")).first()
    assert math.isclose(r_.c, 0.85 * 0.6 * 0.9)
    want = 0.6 * 1.2 * 2 * 0.8 * r_.c
    assert math.isclose(r_.s, want / (1 + want))


def test_propagation_relaxes(spark):
    """A chain's decay is that of the depth it leaves from, and a longer but stronger route still lifts confidence."""
    e = spark.createDataFrame([edge("b", "a"), edge("c", "b", only=True), edge("d", "c"), edge("x", "d"), edge("a", "d"), edge("a", "a")], EDGE)
    got = {x.file: (x.depth, round(x.confidence, 6)) for x in im.propagate(e, spark.createDataFrame([("a",)], "file string")).where("not seed").collect()}
    assert got == {"b": (1, 0.85), "c": (2, round(0.85 * 0.75 * 0.95, 6)), "d": (3, round(0.85 * 0.75 * 0.95 * 0.85 * 0.95**2, 6))}
    start = spark.createDataFrame([("weak", 0, 0.5, 0.21), ("strong", 0, 0.5, 1.0)], "file string, depth int, severity double, confidence double")
    e = spark.createDataFrame([edge("t", "weak"), edge("m", "strong"), edge("weak", "m"), edge("u", "t")], EDGE)
    got = {x.file: (x.depth, round(x.confidence, 6)) for x in im.propagate(e, start, 4).collect()}
    lifted = 0.85 * 0.85 * 0.95  # weak, by way of m
    assert got["weak"] == (0, round(lifted, 6)) and got["t"] == (1, round(lifted * 0.85 * 0.95**2, 6)) and got["u"][0] == 2
    assert {x.file for x in im.propagate(e, start, 4, F.col("file") == "m").collect()} == {"weak", "strong", "t", "u"}


def test_seeds_and_direct_references(spark):
    e = spark.createDataFrame([edge("i", "gone"), edge("j", "was"), edge("k", "bin"), edge("l", "plain"), edge("known", "gone"), edge("t.test.ts", "gone")], EDGE)
    changes = spark.createDataFrame([("gone", None, "deleted", False), ("now", "was", "renamed", False), ("bin", None, "modified", True), ("plain", None, "modified", False)], "path string, old_path string, kind string, whole boolean")
    got = {(x.file, x.severity, x.reason) for x in im.seeds(e, changes, spark.createDataFrame([("known",)], "file string"), F.col("file").contains(".test.")).collect()}
    assert got == {("i", 0.6, "transitive"), ("j", 0.6, "transitive"), ("k", 0.45, "fileLevelChange")}
    changed = spark.createDataFrame([("s", "n", "f", True, False), ("u", "m", "f", False, True)], "id string, name string, file string, exported boolean, type_only boolean")
    refs = spark.createDataFrame([("s", "x", "importAlias", "low"), ("s", "x", "directRef", None), ("u", "x", "directRef", "medium"), ("s", "y", "namespaceMember", None), ("zz", "x", "directRef", None)], "def_id string, file string, reason string, resolution string")
    got = {x.file: (round(x.severity, 6), x.confidence, x.reasons, x.symbols, x.resolution) for x in im.direct_references(changed, refs, e).collect()}
    assert got == {"x": (round(1.2 / 2.2, 6), 1.0, "directRef,importAlias", "m,n", "low"), "y": (round(0.8 * 1.2 * 0.9 / (1 + 0.8 * 1.2 * 0.9), 6), 0.9, "namespaceMember", "n", None)}
    assert im.direct_references(changed, refs, e, keep=1).count() == 1


def test_review_tasks(spark):
    row = spark.range(1).select(rv.tasks(*map(F.lit, (1, 0, 10, 3, 1, 1))).alias("all"), rv.tasks(*map(F.lit, (0, 2, 1, 1, 0, 0))).alias("few")).first()
    assert [t.id for t in row.all] == rv.TASKS and [t.id for t in row.few] == ["review-summary"]


def test_surfaces(spark):
    s = spark.createDataFrame([("1", "a", "f", True, None), ("2", "b", "f", True, "doc"), ("3", "c", "g", False, None)], "id string, name string, file string, exported boolean, docstring string")
    e = spark.createDataFrame([("3", "1"), ("2", "2")], "from_id string, to_id string")
    assert [x.id for x in r.unused_exports(s, e).collect()] == ["2"]
    assert [tuple(x) for x in r.undocumented(s).collect()] == [("f", "a")]
    assert [tuple(x) for x in r.symbol_coupling(s, e).collect()] == [("g", "f", 1)]


def test_links_tree_ids(spark):
    known = spark.createDataFrame([("docs/a.md",), ("docs/b.md",), ("img.png",)], "path string")
    anchors = spark.createDataFrame([("docs/a.md", "top"), ("docs/b.md", "top")], "path string, anchor string")
    told = {"b.md#top": "ok", "b.md#no": "missing_fragment", "../img.png#x": "ok", "/img.png": "ok", "#top": "ok", "#no": "missing_fragment", "../../x": "outside_root", "c.md": "missing_file", "https://x/y": "external", "//x": "external", None: "missing_reference", "a/b/c/d/e/../../../../.././b.md": "ok"}
    found = spark.createDataFrame([("docs/a.md", t) for t in told], "file string, destination string")
    assert {x.destination: x.status for x in r.broken_links(found, known, anchors).collect()} == told
    pages = spark.createDataFrame([(1, """<a href='x?a=1' class=b><IMG srcset="a.png 1x, b.png 2x" src=c.png><p href="no"><video src="v"><a data-href="no">"""), (2, None)], "page_id int, html string")
    got = {(x.tag, x.attribute, x.target) for x in r.html_references(pages).collect()}
    assert got == {("a", "href", "x?a=1"), ("img", "srcset", "a.png"), ("img", "srcset", "b.png"), ("img", "src", "c.png"), ("video", "src", "v")}
    assert {tuple(x) for x in r.tree(spark.createDataFrame([("a/b/c/d/e.ts",), ("a/x.ts",), ("top.ts",)], "path string"), 2).collect()} == {("a", 2), ("a/b", 1)}
    c = r.chunk_ids(spark.createDataFrame([("f", 1, "t"), ("f", 2, "t"), ("g", 1, "t")], "file string, ordinal int, text string")).collect()
    assert sorted((x.file, x.ordinal, x.chunk_id[16:]) for x in c) == [("f", 1, ""), ("f", 2, ":1"), ("g", 1, "")]


def test_innermost_symbols_of_many_equal_ranges(spark, monkeypatch):
    """Equal ranges and repeated lines cost nothing twice; tasks hold a bounded number of lines."""
    from tessera import storage
    from tessera.operators import reports

    symbols = spark.createDataFrame([("f", f"s{k:03}", 1, 100) for k in range(200)] + [("f", "in", 40, 70), ("g", "x", 1, 9)], "file string, id string, start long, end long")
    lines = spark.createDataFrame([("f", k % 120) for k in range(600)] + [("g", 5), ("h", 1)], "file string, line long")
    want = {("f", k, "in" if 40 <= k <= 70 else "s000") for k in range(1, 101)} | {("g", 5, "x")}
    monkeypatch.setattr(storage, "ROWS", 10)
    got = reports.changed_symbols(lines, symbols)
    assert got.rdd.getNumPartitions() == 13 and sorted(map(tuple, got.collect())) == sorted(want)


def test_unknown_ends_that_stay_are_no_drift(spark):
    """An edge without a raw name on both sides is the same edge; type-only turns are told by what is new."""
    base = spark.createDataFrame([("a", "b", "file", None, False, None, None, 0), edge("a", "c"), edge("a", "d"), edge("a", "d", only=True), edge("b", "e", only=True)], EDGE)
    head = spark.createDataFrame([("a", "b", "file", None, False, None, None, 0), edge("a", "c", only=True), edge("a", "d"), edge("b", "f"), edge("b", "f", only=True)], EDGE)
    got = {(x.kind, x.severity, x.key.replace(dr.NUL, "|")) for x in dr.edge_findings(base, head).collect()}
    assert got == {
        ("graph-edge-type-changed", "info", "a|c|c"),
        ("graph-edge-removed", "info", "a|d|d|type"),
        ("graph-edge-removed", "info", "b|e|e|type"),
        ("graph-edge-added", "info", "b|f|f|type"),
        ("graph-edge-added", "info", "b|f|f|value"),
    }
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert [(x.kind, x.key) for x in dr.set_findings(keys("a", None, "c"), keys("a", None), "new-cycle", "resolved-cycle").collect()] == [("resolved-cycle", "c")]
