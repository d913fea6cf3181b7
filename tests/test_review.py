from pyspark.sql import functions as F

from tessera.functions import bloom
from tessera.operators import review as r

EDGE = "from_path string, to_path string, to_type string, type_only boolean"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, "file", False) if len(x) == 2 else (a, b, "file", x[2]) for x in rows for a, b in [x[:2]]], EDGE)


def test_type_flips_pair_one_to_one(spark):
    base, head = edges(spark, [("a", "b", True), ("a", "b", True), ("c", "d", False)]), edges(spark, [("a", "b", False), ("c", "d", False), ("e", "f", True)])
    assert [tuple(x) for x in r.type_flips(base, head).collect()] == [("a", "b", True, False)]


def test_candidate_tests(spark):
    e = edges(spark, [("t1.test.ts", "x.ts"), ("m.ts", "x.ts"), ("t2.test.ts", "m.ts"), ("x.test.ts", "other.ts"), ("t3.test.ts", "other.ts")])
    got = [tuple(x) for x in r.candidate_tests(e, spark.createDataFrame([("x.ts",)], "file string"), lambda p: p.contains(".test.")).collect()]
    assert got == [("t1.test.ts", "high"), ("t2.test.ts", "medium"), ("x.test.ts", "low")]


def test_simple_paths(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e")])
    got = {">".join(x.path) for x in r.simple_paths(e, spark.createDataFrame([("a",)], "file string")).collect()}
    assert got == {"a>b", "a>b>c", "a>b>c>d"}


def test_targets(spark):
    s = spark.createDataFrame([("1", "f", "n"), ("2", "g", "n"), ("n2", "g", "m")], "id string, file string, name string")
    ask = lambda t: sorted(tuple(x) for x in r.resolve_target(s, t).collect())
    assert ask("1") == [("1", "found")] and ask("g::n") == [("2", "found")] and ask("n") == [("1", "ambiguous"), ("2", "ambiguous")] and ask("zz") == []


def test_call_compatibility(spark):
    df = spark.createDataFrame([(1, 2, 3), (4, 2, 3), (2, 2, None), (None, 1, 1), (3, 2, 3)], "a int, lo int, hi int")
    assert [x.c for x in df.select(r.call_compatibility(F.col("a"), F.col("lo"), F.col("hi")).alias("c")).collect()] == ["too_few", "too_many", "compatible", "unknown", "compatible"]


def test_lines_saved_and_clusters(spark):
    s = spark.createDataFrame([("g", "f", 1, 10), ("g", "f", 5, 12), ("g", "h", 1, 5), ("k", "f", 1, 3)], "group string, file string, start int, end int")
    assert {tuple(x) for x in r.lines_saved(s).collect()} == {("g", 5), ("k", 0)}
    got = {tuple(x) for x in r.impact_clusters(edges(spark, [("a", "b"), ("c", "z")]), spark.createDataFrame([("a",), ("b",), ("c",)], "file string")).collect()}
    assert got == {("a", 2), ("c", 1)}


def test_bloom_has_no_false_negatives(spark):
    bits, hashes = bloom.sizing(50)
    items = spark.createDataFrame([(k % 3, f"id{k}") for k in range(150)], "k int, x string")
    f = bloom.filters(items, "k", "x", bits, hashes)
    assert items.join(f, "k").where(~bloom.might_contain(F.col("bits"), F.col("x"), bits, hashes)).count() == 0
    misses = items.select(F.concat(F.lit("no"), "x").alias("x")).crossJoin(f).where(bloom.might_contain(F.col("bits"), F.col("x"), bits, hashes)).count()
    assert misses < 45 and bloom.sizing(0)[0] == 1000 and bloom.sizing(10**9)[1] >= 1


def test_bloom_holding_equals_filters(spark):
    items = spark.range(3000).selectExpr("id % 40 as k", "concat('w', id) as x")
    for sought in ("w17", "absent", "w2999"):
        want = bloom.filters(items, "k", "x", 200, 3).where(bloom.might_contain(F.col("bits"), F.lit(sought), 200, 3)).select("k")
        assert sorted(map(tuple, bloom.holding(items, "k", "x", sought, 200, 3).collect())) == sorted(map(tuple, want.collect())) != []
