import random
import re

import pytest

from tessera.llm import licenses as L

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_base_against_brute_force(spark):
    rng = random.Random(3)
    bits = ["Under the", "MIT", "license", "apache License, Version 2", ".0", "CC-BY-NC", "cc by", "nc", "under", "the", "été", "\n", "x", "CC BY NC"]
    rows = [(1, None), (2, ""), (3, "under the MIT license" * 2), (4, "cc by nc cc by nc " * 2000), (5, "ÀCC BY NC"), (6, "..."), (7, "İ under the mit license")]
    rows += [(10 + k, " ".join(rng.choices(bits, k=rng.randrange(60)))) for k in range(200)]
    df = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, labels string, score double")
    got = L.scan(df).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("SPDX-License-Identifier: MIT", "mit", 1.0),
        ("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0", "apache-2,gpl-2,mit", 1.0),
        ("SPDX-License-Identifier: MIT AND GPL-3.0+", "gpl-3,mit", 0.2),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2", 0.2),
        ("SPDX-License-Identifier: MIT OR\nGPL-2.0", "mit", 1.0),
        ("SPDX-License-Identifier: ((MIT", "mit", 1.0),
        ("SPDX-License-Identifier: and", "", 0.5),
        ("no notice", "", 0.5),
    ],
)
def test_expressions(text, labels, score):
    _, _, _, _, _, got, value, _ = L.Scanner()(text)
    assert (got, value) == (labels, score)


def test_long_expressions():
    many = [f"x{k}" for k in range(300)]
    _, _, _, _, _, labels, score, _ = L.Scanner()("SPDX-License-Identifier: " + " AND ".join(["MIT"] * 300 + ["GPL-3.0"]))
    assert (labels, score) == ("gpl-3,mit", 0.2)
    _, _, _, _, _, labels, score, _ = L.Scanner()("SPDX-License-Identifier: (" + " or ".join([*many, "mit"]) + ")")
    assert (set(labels.split(",")), score) == ({*many, "mit"}, 1.0)


def test_overlapping_phrases_in_a_long_text():
    text = "licensed under the MIT license " * 50_000
    n, base, first, last, *_ = L.Scanner()(text)
    assert (n, base, first, last) == (250_000, 50_000, 1, 249_996)


def test_precedence():
    assert L.postfix(["a", "or", "b", "and", "c", "with", "d"]) == ["a", "b", "c", "d", "with", "and", "or"]
    assert L.postfix(["(", "a", "or", "b", ")", "and", "c"]) == ["a", "b", "or", "c", "and"]
    assert L.postfix(["a", "b"]) is None and L.postfix(["(", "a"]) is None and L.postfix([]) is None


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
