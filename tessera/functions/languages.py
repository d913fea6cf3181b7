"""The two small query languages: symbol filters and canned questions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'(\w+):"([^"]*)"|(\w+):(\S*)|"([^"]*)"|(\S+)')


@dataclass
class SymbolFilter:
    kinds: list[str] = field(default_factory=list)
    name: str = ""
    file: str = ""
    doc: str = ""
    text: str = ""

    def column(self) -> Column:
        """The conjunction of all parts; comparison ignores case."""
        out = F.lit(True)
        if self.kinds:
            out = out & F.col("kind").isin(*self.kinds)
        for value, column in ((self.name, "name"), (self.file, "file"), (self.doc, "docstring")):
            if value:
                out = out & F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(value.lower()))
        if self.text:
            parts = [F.when(F.col(c) != "", F.col(c)) for c in ("name", "file", "docstring")]
            out = out & F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(self.text.lower()))
        return out


def parse_symbol_query(query: str) -> SymbolFilter:
    """``kind:a,b name:x file:y doc:"z w" free text``; unknown keys are free text, empty values count for nothing."""
    out, free = SymbolFilter(), []
    for m in _TOKEN.finditer(query):
        key, value = m[1] or m[3], m[2] if m[1] else m[4] if m[3] else m[5] if m[5] is not None else m[6]
        known = {"kind": "kinds", "kinds": "kinds", "name": "name", "file": "file", "doc": "doc", "docstring": "doc"}.get((key or "").lower())
        if known == "kinds":
            out.kinds += [k for k in value.split(",") if k]
        elif known and value:
            setattr(out, known, value)
        elif not known and m[0]:
            free.append(m[0] if key else value)
    out.text = " ".join(free)
    return out


@dataclass
class Question:
    plan: str
    limit: int = 10
    subject: str = ""


def parse_question(text: str) -> Question:
    """One of the seven plans, with ``top N`` or ``most N`` as its limit."""
    low = text.lower().strip()
    m = re.search(r"\b(?:top|most)\s+(\d+)", low)
    limit = int(m[1]) if m else 10
    subject = (re.search(r"(?:implement(?:ing|s)?|chain (?:for|of)|module|by)\s+[\"'`]?([\w./-]+)", text, re.I) or [None, ""])[1]
    rules = (
        (r"called function|most called", "most_called"),
        (r"dependency chain", "dependency_chain"),
        (r"controller.*endpoint", "controllers_endpoints"),
        (r"implement", "classes_implementing"),
        (r"affected|impacted", "affected_functions"),
        (r"complex.*class|class.*complex", "complex_class"),
        (r"complex", "complex_function"),
    )
    for pattern, plan in rules:
        if re.search(pattern, low):
            return Question(plan, limit, subject)
    raise ValueError("Unsupported query text.")
