import pathlib

from tessera.sources import pycode as p

TEXT = '''"""Module."""
import os
LIMIT = 3
_hidden = 1

@deco
def top(a):
    """Doc."""
    if a and os.sep:
        return [x for x in a]
    return helper(a)


class Box:
    size = 2

    def put(self, x):
        def inner():
            return x
        return inner

    async def get(self):
        try:
            return self.put(1)
        except KeyError:
            return None
'''


def files(spark, **texts):
    return spark.createDataFrame([(k, v) for k, v in texts.items()], "path string, text string")


def test_records(spark):
    rows = {(r.path, r.qualified): r for r in p.records(files(spark, a=TEXT, b="__all__ = ['y']\nx = 1\ny: int = 2\n", bad="def (", none=None)).collect()}
    got = {q: (r.kind, r.start, r.end, r.exported, r.complexity) for (f, q), r in rows.items() if f == "a"}
    assert got == {"LIMIT": ("variable", 3, 3, True, 1), "_hidden": ("variable", 4, 4, False, 1), "top": ("function", 6, 11, True, 3), "Box": ("class", 14, 26, True, 2), "Box.put": ("method", 17, 20, False, 1), "Box.put.inner": ("function", 18, 19, False, 1), "Box.get": ("method", 22, 26, False, 2)}
    assert rows["a", "top"].docstring == "Doc." and (rows["b", "x"].exported, rows["b", "y"].exported) == (False, True) and rows["bad", ""].kind == "unparsed"
    same = p.records(files(spark, a="def f(a):\n    return g(a, 1)\n", b="def other(zz):\n    return name(zz, 2)\n", c="def f(a):\n    return g(a)\n")).collect()
    shapes = {r.path: r.shape for r in same}
    assert shapes["a"] == shapes["b"] != shapes["c"]


def test_tree_grep(spark):
    found = p.tree_grep(files(spark, a=TEXT), "Call").collect()
    assert {(r.line, r.name) for r in found} == {(11, "helper"), (24, "put")}
    assert [(r.line, r.column) for r in p.tree_grep(files(spark, a=TEXT, bad="("), "ClassDef", "Box").collect()] == [(14, 1)]


def test_chunks_cover_every_file(spark):
    own = {str(f.name): f.read_text() for f in pathlib.Path(p.__file__).parent.glob("*.py")} | {"t": TEXT, "bad": "def (\n" * 40, "empty": "", "long": "x = 1 \n" * 3000}
    found: dict = {}
    for r in p.chunk_code(files(spark, **own), 20, 120).collect():
        found.setdefault(r.path, []).append(r)
    assert set(found) == set(own)
    for path, rows in found.items():
        rows.sort(key=lambda r: r.ordinal)
        assert all(r.tokens <= 120 and r.tokens == len(r.text.split()) for r in rows)
        assert "\n".join(r.text for r in rows) == own[path] if all(a.end < b.start for a, b in zip(rows, rows[1:], strict=False)) else True
        covered = [n for r in rows for n in range(r.start, r.end + 1)]
        assert sorted(set(covered)) == list(range(1, own[path].count("\n") + 2))
    kinds = {r.name: r.kind for r in p.chunk_code(files(spark, t=TEXT), 2, 20).collect() if r.name}
    assert kinds == {"top": "function", "put": "function", "get": "function"}
