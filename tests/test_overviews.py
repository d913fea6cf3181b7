from tessera.functions import textual
from tessera.operators import review

EDGE = "from_path string, to_path string, to_type string, raw string, type_only boolean, resolved string, confidence double, seq long"


def test_orient_and_review(spark):
    pairs = [("src/a.ts", "src/b.ts"), ("src/b.ts", "src/a.ts"), ("tests/a.test.ts", "src/a.ts"), ("lib/c.ts", "tests/a.test.ts")]
    edges = spark.createDataFrame([(a, b, "file", b, False, "precise", 1.0, k) for k, (a, b) in enumerate(pairs)], EDGE)
    files = spark.createDataFrame([(p,) for p in ["src/a.ts", "src/b.ts", "tests/a.test.ts", "lib/c.ts"]], "path string")
    got = [tuple(r) for r in review.orient(files, edges).collect()]
    assert {r[1:] for r in got if r[0] == "directory"} == {("src", 2), ("tests", 1), ("lib", 1)}
    assert [r[1:] for r in got if r[0] == "hotspot"][0] == ("src/a.ts", 5)  # two importers, one import
    assert [r[1:] for r in got if r[0] == "cycle"] == [("src/a.ts,src/b.ts", 3 * 2 + 2 * 1 + 2)]
    symbols = spark.createDataFrame([("1", "src/a.ts", True), ("2", "src/b.ts", True)], "id string, file string, exported boolean")
    one = review.review(files, edges, symbols, spark.createDataFrame([("src/a.ts",)], "file string"), textual.is_test_file).first()
    assert (one.changed_files, one.missing, one.changed_symbols, one.exported_symbols, one.impacted_files, one.tests, one.risk, one.level) == (1, 0, 1, 1, 3, 1, 60, "medium")


def test_orient_tells_all_cycles_if_asked(spark):
    pairs = [(f"c{k:02}{x}.ts", f"c{k:02}{y}.ts") for k in range(12) for x, y in ("ab", "ba")]
    edges = spark.createDataFrame([(a, b, "file", b, False, "precise", 1.0, k) for k, (a, b) in enumerate(pairs)], EDGE)
    files = spark.createDataFrame([(p,) for p, _ in pairs], "path string")
    cycles = lambda **most: review.orient(files, edges, **most).where("section = 'cycle'").count()
    assert cycles() == 10 and cycles(most=None) == 12
