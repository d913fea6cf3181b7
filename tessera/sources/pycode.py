"""Records, blocks, chunks and tree searches of Python files, by the standard library's parser.

Every text is parsed where its row is; nothing is shuffled. A text that doesn't
parse gives one record of kind ``unparsed`` and is chunked by lines.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..operators.chunking import packed_lines

_BRANCH = re.compile(r"\bif\b|\bfor\b|\bwhile\b|\bcase\b|\bcatch\b|\belse\s+if\b|\belif\b|\bexcept\b|&&|\|\||\?[^?.]")
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
#: Rows of an Arrow batch that are parsed before their results go on.
STEP = 128


def _mapped(files: DataFrame, of: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    fields = _parse_datatype_string(schema).fields
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                part = b.slice(at, STEP)
                rows = [r for path, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in of(path, text or "")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "text").mapInArrow(run, schema)


def _parsed(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _first_line(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def _complexity(lines: list[str], start: int, end: int) -> int:
    return 1 + len(_BRANCH.findall("\n".join(lines[start - 1 : end])))


def shape(node: ast.AST) -> str:
    """16 hex digits of the kinds of a tree's nodes, whatever names and values it holds."""
    kinds: list[str] = []
    stack: list[ast.AST | None] = [node]
    while stack:
        n = stack.pop()
        if n is None:
            kinds.append(")")
            continue
        kinds.append(type(n).__name__)
        stack += [None, *reversed(list(ast.iter_child_nodes(n)))]
    return hashlib.sha256(" ".join(kinds).encode()).hexdigest()[:16]


RECORD = "path string, name string, qualified string, kind string, start int, end int, exported boolean, docstring string, complexity int, shape string"


def records(files: DataFrame) -> DataFrame:
    """Definitions of ``files`` (path, text): functions, methods, classes and top-level names, with docstring, complexity and tree shape.

    What a module's ``__all__`` lists is exported, else its top-level names without an underscore in front.
    """

    def of(path: str, text: str) -> Iterator[tuple]:
        tree = _parsed(text)
        if tree is None:
            yield path, "", "", "unparsed", 1, text.count("\n") + 1, False, None, 0, ""
            return
        lines, listed = text.split("\n"), None
        for n in tree.body:
            if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)):
                listed = {e.value for e in n.value.elts if isinstance(e, ast.Constant)}

        def public(name: str) -> bool:
            return name in listed if listed is not None else not name.startswith("_")

        stack: list[tuple[ast.AST, str, bool]] = [(n, "", True) for n in reversed(tree.body)]
        while stack:
            n, inside, top = stack.pop()
            if isinstance(n, _DEFS):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if inside.endswith("#") else "function"
                full = inside.replace("#", "") + n.name
                start = _first_line(n)
                yield path, n.name, full, kind, start, n.end_lineno, top and public(n.name), ast.get_docstring(n), _complexity(lines, start, n.end_lineno), shape(n)
                stack += [(c, full + "." + ("#" if kind == "class" else ""), False) for c in reversed(n.body)]
            elif top and isinstance(n, (ast.Assign, ast.AnnAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and t.id != "__all__":
                        yield path, t.id, t.id, "variable", n.lineno, n.end_lineno, public(t.id), None, 1, shape(n)
            elif hasattr(n, "body") and isinstance(n.body, list):
                stack += [(c, inside, top) for c in reversed([*n.body, *getattr(n, "orelse", []), *getattr(n, "finalbody", [])])]

    return _mapped(files, of, RECORD)


def tree_grep(files: DataFrame, kind: str, name: str | None = None) -> DataFrame:
    """(path, line, column, name) of the nodes of a ``kind`` (Call, ClassDef, Import, ...), optionally of one ``name``; lines and columns from 1."""

    def named(n: ast.AST) -> str:
        if isinstance(n, ast.Call):
            n = n.func
        for field in ("name", "attr", "id", "arg", "module"):
            if isinstance(getattr(n, field, None), str):
                return getattr(n, field)
        return ""

    def of(path: str, text: str) -> Iterator[tuple]:
        tree = _parsed(text)
        for n in ast.walk(tree) if tree is not None else ():
            if type(n).__name__ == kind and hasattr(n, "lineno") and (name is None or named(n) == name):
                yield path, n.lineno, n.col_offset + 1, named(n)

    return _mapped(files, of, "path string, line int, column int, name string")


def blocks(text: str, most: int) -> list[tuple[int, int, str, str]]:
    """(first line, last line, kind, name) of the definitions that become chunks: the greatest that hold at most ``most`` tokens, of greater ones what is in them."""
    tree = _parsed(text)
    if tree is None:
        return []
    lines, out = text.split("\n"), []
    stack = [n for n in reversed(tree.body) if isinstance(n, _DEFS)]
    while stack:
        n = stack.pop()
        start, end = _first_line(n), n.end_lineno
        inner = [c for c in n.body if isinstance(c, _DEFS)]
        if not inner or len(" ".join(lines[start - 1 : end]).split()) <= most:
            out.append((start, end, "class" if isinstance(n, ast.ClassDef) else "function", n.name))
        else:
            stack += reversed(inner)
    return sorted(out)


def chunk_code(files: DataFrame, least: int = 20, most: int = 400) -> DataFrame:
    """(path, ordinal, start, end, kind, name, tokens, text): blocks and what lies between them, small neighbours joined, large ones cut.

    Lines between blocks that hold no token stay with the chunk before them. The
    chunks of a file cover its text once, in order.
    """

    def of(path: str, text: str) -> Iterator[tuple]:
        lines = text.split("\n")
        size = lambda a, b: sum(len(x.split()) for x in lines[a - 1 : b])
        spans: list[list] = []
        at = 1
        for a, b, kind, name in [*blocks(text, most), (len(lines) + 1, len(lines), "", "")]:
            if at < a:
                if size(at, a - 1) or not spans:
                    spans.append([at, a - 1, "misc", ""])
                else:
                    spans[-1][1] = a - 1
            if kind:
                spans.append([a, b, kind, name])
            at = max(at, b + 1)
        joined: list[list] = []
        for s in spans:
            last = joined[-1] if joined else None
            if last and size(*last[:2]) < least and size(last[0], s[1]) <= most:
                last[1], last[2], last[3] = s[1], f"{last[2]}+{s[2]}", last[3] or s[3]
            else:
                joined.append(s)
        k = 0
        for a, b, kind, name in joined:
            body = "\n".join(lines[a - 1 : b])
            parts = [(a, b, body, size(a, b))] if size(a, b) <= most else [(a + x - 1, a + y - 1, t, n) for x, y, t, n in packed_lines(body, most)]
            for x, y, t, n in parts:
                yield path, k, x, y, kind, name, n, t
                k += 1

    return _mapped(files, of, "path string, ordinal int, start int, end int, kind string, name string, tokens int, text string")
