import math
import random
import re
from collections import Counter

import pytest
import xxhash

from tessera.llm import quality_rules as q

B = q.BUCKETS


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base(t):
    w, t = words(t), t or ""
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def buckets(t):
    w = words(t)
    h = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed)
    return [h(a) % B for a in w] + [h(b, h(a)) % B for a, b in zip(w, w[1:], strict=False)]


def rows():
    rng = random.Random(9)
    vocab = ["le", "chat", "Été", "noir", "#tag", "a|b", "x" * 30, "dog", "and"] + [f"w{k}" for k in range(80)]
    out = [(1, None), (2, ""), (3, " \n\t\x0b\f\r "), (4, "one"), (5, "a b c"), (6, "a b c d a b c"), (7, "x y " * 20_000), (8, "l\nl\n\nl \n \nl"), (9, "\x1fa\x00b c d")]
    out += [(20 + k, rng.choice([" ", "\n", "  "]).join(rng.choices(vocab, k=rng.randrange(1, 150)))) for k in range(120)]
    return out + [(300 + k, " ".join(rng.choice(vocab[:12]) + "&&&" for _ in range(80))) for k in range(40)] + [(20, "again " * 60)]


def test_against_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "clash", True) for i, t in data], "doc_id long, text string, ratio string, kept boolean").repartition(3)
    good = [i for i in range(20, 140) if i % 3 == 0]
    trusted = q.trusted_ids(spark.createDataFrame([(i, 1) for i in good] + [(300, 0), (None, 1), (22, None), (21, 1), (21, 1)], "doc_id long, quality int"))
    raw, ct = Counter(), Counter()
    for i, t in data:
        raw.update(buckets(t))
        if i in good:
            ct.update(buckets(t))
    nr, nt = sum(raw.values()), sum(ct.values())
    got = Counter()
    for r in q.judge(docs, trusted).collect():
        got[r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, None if r.ratio is None else round(r.ratio, 8)] += 1
    want = Counter()
    for i, t in data:
        b, x = base(t), buckets(t)
        ratio = sum(round(1e6 * math.log((ct[k] + 16) / (raw[k] * nt / nr + 16))) for k in x) / len(x) / 1e6 if x else None  # whole millionths
        want[i, *b, not b[-1] and ratio >= q.THRESHOLD, None if ratio is None else round(ratio, 8)] += 1
    assert got == want
    assert {k[0]: k[7] for k in want}[305] is False


def test_no_trusted_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e " + " ".join(f"w{k}" for k in range(60))), (None, "x")], "doc_id long, text string")
    none = q.trusted_ids(spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.doc_id: r.kept for r in q.judge(docs, none).collect()} == {1: True, None: False}
    assert q.judge(docs.where("false"), none).count() == 0


@pytest.mark.parametrize("n", [10])
def test_trusted_bound(spark, n):
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    assert q.trusted_ids(labels, most=n).count() == n
