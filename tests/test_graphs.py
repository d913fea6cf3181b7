import random

import pytest

from tessera.operators import graphs as g

EDGE = "from_path string, to_path string, to_type string, raw string, type_only boolean, resolved string, confidence double, seq long"


def edges(spark, pairs, **more):
    rows = [(a, b, more.get("to_type", "file"), f"./{b}", False, None, None, k) for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, EDGE)


def test_cycle_of_three_with_outside_importer(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b")])
    assert [tuple(r) for r in g.cycles(e).collect()] == [("a,b,c", 3, 3, 1, 1, 14, "c")]


def test_self_loop_chain_and_no_cycle(spark):
    chain = [(f"n{k:02}", f"n{k + 1:02}") for k in range(12)] + [("n12", "n00"), ("z", "z")]
    got = {r.files: r["size"] for r in g.cycles(edges(spark, chain)).collect()}
    assert got == {",".join(f"n{k:02}" for k in range(13)): 13, "z": 1}
    assert g.cycles(edges(spark, [("a", "b"), ("b", "c")])).count() == 0
    assert g.cycles(edges(spark, [])).count() == 0


def test_long_chains(spark):
    """A ring of 5,000 files, a dead end as long, and a chain back into a small cycle take rounds by the logarithm of their length."""
    n = 5000
    ring = [(f"r{k}", f"r{(k + 1) % n}") for k in range(n)]
    end = [(f"e{k:05}", f"e{k + 1:05}") for k in range(n)]
    handle = [("a", "b"), ("b", "a"), ("a", "h0")] + [(f"h{k}", f"h{k + 1}") for k in range(300)] + [("h300", "b")] + [("q", "q1"), ("q1", "q2"), ("q2", "q"), ("q", "a")]
    got = {}
    for r in g.strong_components(edges(spark, ring + end + handle)).collect():
        got.setdefault(r.component, set()).add(r.node)
    want = [{a for a, _ in ring}, {"a", "b"} | {f"h{k}" for k in range(301)}, {"q", "q1", "q2"}]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and all(c == max(m) for c, m in got.items())


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range([30, 45, 60, 120][seed])]
    reach = {a: {b for x, b in pairs if x == a and b != a} for a in {x for p in pairs for x in p}}
    for _ in range(40):
        reach = {a: to | {c for b in to for c in reach[b]} for a, to in reach.items()}
    want = {frozenset(b for b in reach if b == a or (b in reach[a] and a in reach[b])) for a in reach}
    got = {}
    for r in g.strong_components(edges(spark, pairs)).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(m) for m in got.values()} == {m for m in want if len(m) > 1} and all(c == max(m) for c, m in got.items())


@pytest.mark.parametrize(("seed", "local"), [(0, 0), (1, 0), (2, 7), (3, 40), (2, 1000)])
def test_components_by_rounds_and_by_small_chunks(spark, seed, local):
    """Whether one task, small chunks or rounds of joins find them, components are the same."""
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range([25, 40, 60, 120][seed])]
    reach = {a: {b for x, b in pairs if x == a} for a in {x for p in pairs for x in p}}
    for _ in range(30):
        reach = {a: to | {c for b in to for c in reach[b]} for a, to in reach.items()}
    want = {a: max(b for b in reach[a] if a in reach[b]) for a in reach if any(b != a and a in reach[b] for b in reach[a])}
    assert {r.node: r.component for r in g.strong_components(edges(spark, pairs).repartition(3), local=local).collect()} == want


def test_dense_graphs_are_thinned(spark):
    """Of all links within two groups, links from one to the other and a loop, two rings, one link for each task and the loop are left."""
    pairs = [(f"{c}{a:02}", f"{c}{b:02}") for c in "xy" for a in range(40) for b in range(40) if a != b]
    pairs += [(f"x{a:02}", f"y{b:02}") for a in range(40) for b in range(40)] + [("z", "z")]
    links = spark.createDataFrame(pairs, "u string, v string").coalesce(1)
    table, n = g.thinned(links)
    assert n == 82 and table.where("u = v").count() == 1 and table.where("u = 'x39' and v = 'y39'").count() == 1
    many, m = g.thinned(links.repartition(4), 500)
    assert m < 500 and {r.node: r.component for r in g.strong_components(many, "u", "v").collect()} == {f"{c}{a:02}": f"{c}39" for c in "xy" for a in range(40)}


def test_weakest_edges_and_document_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x.md", "y.md"), ("y.md", "x.md")])
    coupling = spark.createDataFrame([("a", "b", 3), ("b", "c", 1), ("c", "a", 1)], "from_file string, to_file string, edges long")
    assert [tuple(r) for r in g.weakest_edges(e, coupling).collect()] == [("c", "b", "c", 1, False)]
    assert [r.files for r in g.cycles(e).collect()] == ["a,b,c"]


def test_weakest_edges_reads_its_edges_once(spark):
    e, read = edges(spark, [("a", "b"), ("b", "c"), ("c", "a")]), spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    coupling = spark.createDataFrame([("a", "b", 3), ("b", "c", 1)], "from_file string, to_file string, edges long")
    assert [tuple(r) for r in g.weakest_edges(e.mapInArrow(told, e.schema), coupling).collect()] == [("c", "c", "a", 0, False)]
    assert read.value == 3


def test_two_components_joined_one_way(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e")])
    assert sorted(r.files for r in g.cycles(e).collect()) == ["a,b", "c,d"]


def test_diamond_depths_path_and_limit(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")])
    assert {(r.file, r.depth) for r in g.dependencies(e, "a").collect()} == {("b", 1), ("c", 1), ("d", 2)}
    assert {(r.file, r.depth) for r in g.dependencies(e, "d", reverse=True, depth=1).collect()} == {("b", 1), ("c", 1)}
    assert [r.file for r in g.shortest_path(e, "a", "d").orderBy("position").collect()] == ["a", "b", "d"]
    assert [r.file for r in g.shortest_path(e, "a", "a").collect()] == ["a"]
    assert g.shortest_path(e, "a", "nowhere").count() == 0
    assert {r.file for r in g.dependencies(e, "a", limit=1).collect()} == {"b"}
    assert {r.file for r in g.dependencies(e, "a", limit=3).collect()} == {"b", "c", "d"}


def test_hotspots_count_external_out_edges(spark):
    e = edges(spark, [("a", "b"), ("c", "b")]).unionByName(edges(spark, [("a", "react")], to_type="external"))
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("lone",)], "path string")
    assert [tuple(r) for r in g.hotspots(files, e).collect()] == [("b", 2, 0, 4), ("a", 0, 2, 2), ("c", 0, 1, 1), ("lone", 0, 0, 0)]
    assert g.hotspots(files, e, 0).count() == 0


def test_best_provenance_survives(spark):
    rows = [("a", "b", "file", "x", False, None, 0.9, 0), ("a", "b", "file", "y", False, "heuristic", 0.1, 1), ("a", "b", "file", "z", True, "precise", 0.2, 2), ("a", "b", "file", "w", False, "precise", 0.2, 3), ("a", "b", "external", "e", False, None, None, 4)]
    got = {(r.to_type, r.raw) for r in g.dedupe_edges(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {("file", "z"), ("external", "e")}


@pytest.mark.parametrize(("direction", "want"), [("out", {("s", "t")}), ("in", {("r", "s")}), ("both", {("s", "t"), ("r", "s")})])
def test_neighbors(spark, direction, want):
    e = spark.createDataFrame([("s", "t", "calls"), ("r", "s", "uses"), ("t", "u", "calls"), ("s", "q", None)], "from_id string, to_id string, label string")
    assert {(r.from_id, r.to_id) for r in g.neighbors(e, "s", 1, direction, ["calls", "uses"]).collect()} == want


def test_call_hierarchy(spark):
    e = spark.createDataFrame([("x", "t", "calls", 1), ("x", "t", "calls", 2), ("y", "x", "calls", 3), ("t", "w", "calls", 4), ("z", "t", "uses", 5)], "from_id string, to_id string, label string, seq long")
    s = spark.createDataFrame([(c, c.upper(), "f") for c in "twxyz"], "id string, name string, file string")
    assert [tuple(r) for r in g.call_hierarchy(e, s, "t", 2).collect()] == [("x", "X", "f", 1, 2), ("y", "Y", "f", 2, 1)]
    assert [tuple(r) for r in g.call_hierarchy(e, s, "t", 1, callers=False).collect()] == [("w", "W", "f", 1, 1)]


def test_unresolved(spark):
    e = edges(spark, [("a", "x"), ("b", "x"), ("a", "y"), ("a", "x")], to_type="external")
    assert [tuple(r) for r in g.unresolved_imports(e).collect()] == [("x", "a,b", 2), ("y", "a", 1)]
