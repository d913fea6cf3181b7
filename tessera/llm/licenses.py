"""License scans: an Aho-Corasick automaton finds tags and notice phrases, a shunting-yard parser evaluates expressions.

Texts are lower-cased (A-Z) and cut into words. One automaton over the words,
joined by single spaces, finds every notice phrase on word borders, overlaps
included. A second automaton finds identifier tags (``spdx-license-identifier:``)
in the lower-cased text; the expression after a tag is parsed with AND, OR,
WITH, ``+`` and parentheses.

Score: the chance that use is allowed, from a policy table. A phrase label has
its licence's value; an expression takes the least value over AND, the
greatest over OR, its licence's value over WITH; a document takes the least
over all it states, and ``NO_NOTICE`` if it states nothing.

Defined cases: null text is empty; repeated notices count at each place;
malformed expressions contribute the identifiers that they hold and score as
their AND; expressions and texts may be of any length, in linear time; repeated
rows are rows of their own; empty tables give empty results; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The method's own notice phrases.
PHRASES = BASE_PHRASES | {
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause": "bsd",
    "bsd 2 clause": "bsd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:")
#: Allowance of a label, by prefix, the longest first.
POLICY = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "zlib": 1.0, "cc-by-sa": 0.6, "cc-by-nc": 0.1, "cc-by-nd": 0.2, "cc-by": 0.9, "mpl": 0.7, "lgpl": 0.5, "agpl": 0.1, "gpl": 0.2, "proprietary": 0.0, "licenseref": 0.3}
UNKNOWN, NO_NOTICE = 0.5, 0.5
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LEXEME = re.compile(r"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+-]*)")
_BINARY = {"or": 1, "and": 2, "with": 3}


def allowance(label: str) -> float:
    fit = [p for p in POLICY if label == p or label.startswith((p + "-", p + "."))]
    return POLICY[max(fit, key=len)] if fit else UNKNOWN


def lexemes(text: str, at: int = 0) -> list[str]:
    """Operands and operators from ``at`` while they can form an expression on one line."""
    found: list[str] = []
    depth, operand = 0, True  # operand: one may stand here
    while m := _LEXEME.match(text, at):
        x = m[1]
        if operand:
            if x == ")" or x in _BINARY:
                break
            depth += x == "("
            operand = x == "("
        elif x == ")":
            if not depth:
                break
            depth -= 1
        elif x in _BINARY:
            operand = True
        else:
            break
        found.append(x)
        at = m.end()
    while found and (found[-1] in _BINARY or found[-1] == "("):
        found.pop()
    return found


def postfix(found: list[str]) -> list[str] | None:
    """Shunting-yard: reverse Polish order, or None if the expression is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for x in found:
        if x == "(":
            if not operand:
                return None
            stack.append(x)
        elif x == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif x in _BINARY:
            if operand:
                return None
            while stack and stack[-1] != "(" and _BINARY[stack[-1]] >= _BINARY[x]:
                out.append(stack.pop())
            stack.append(x)
            operand = True
        else:
            if not operand:
                return None
            out.append(x)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(found: list[str]) -> tuple[set[str], float]:
    """Labels and allowance of an expression's lexemes."""
    order = postfix(found)
    if order is None:
        labels = {normal(x) for x in found if x not in _BINARY and x not in "()"}
        return labels, min(map(allowance, labels), default=UNKNOWN)
    stack: list[tuple[set[str], float]] = []
    for x in order:
        if x not in _BINARY:
            label = normal(x)
            stack.append(({label}, allowance(label)))
            continue
        (b, q), (a, p) = stack.pop(), stack.pop()
        stack.append((a, p) if x == "with" else (a | b, min(p, q) if x == "and" else max(p, q)))
    return stack[0]


def normal(name: str) -> str:
    """Identifiers by the labels that phrases have."""
    name = name.rstrip("+.-")
    for known in ("apache-2", "gpl-2", "gpl-3"):
        if name == known or name.startswith(known + "."):
            return known
    for known in ("lgpl", "agpl", "mpl", "bsd", "cc-by-nc", "cc-by-sa", "cc-by-nd", "cc0", "unlicense"):
        if name == known or name.startswith(known + "-"):
            return known
    return name


class Scanner:
    def __init__(self):
        import ahocorasick

        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for p, label in PHRASES.items():
            self.phrases.add_word(f" {p} ", (p, label))
        for t in TAGS:
            self.tags.add_word(t, t)
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def __call__(self, text: str | None) -> tuple:
        """(n_words, n_base, first, last, base labels, labels, score, spans)"""
        low = (text or "").encode().lower().decode()  # bytes.lower() changes A-Z only
        words = _WORDS.findall(low)
        joined = f" {' '.join(words)} "
        starts, base, labels, values, spans = [], set(), set(), [], []
        blanks: list[int] = []  # the blank before each word, as soon as one is asked for
        for end, (p, label) in self.phrases.iter(joined):
            blanks = blanks or list(accumulate((len(w) + 1 for w in words), initial=0))
            seen = bisect_left(blanks, end - len(p) - 1)
            labels.add(label)
            values.append(allowance(label))
            spans.append((seen, seen + p.count(" ") + 1, label))
            if p in BASE_PHRASES:
                starts.append(seen)
                base.add(label)
        for end, _ in self.tags.iter(low):
            if found := lexemes(low, end + 1):
                more, value = evaluate(found)
                labels |= more
                values.append(value)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(values, default=NO_NOTICE), spans


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, first and last base phrase, labels, score, and spans in words (end exclusive).

    A label that holds a comma can't arise: phrases are fixed and identifiers
    have none.
    """
    rest = T._parse_datatype_string(SCHEMA)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *rest.fields])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                rows = [scanner(t.as_py()) for t in part.column(1)]
                cols = list(zip(*rows, strict=True))
                data = [pa.array(c, k) for c, k in zip(cols[:7], kinds, strict=True)]
                data.append(pa.array([[{"start": x, "end": y, "label": z} for x, y, z in r] for r in cols[7]], span))
                yield pa.RecordBatch.from_arrays([part.column(0), *data], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
