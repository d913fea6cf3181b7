import random
import re
from collections import Counter

import pytest

from tessera.llm import decontamination as d


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, n=13):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        x = words(t)
        if not x or i is None:
            continue
        for k in range(max(1, len(x) - n + 1)):
            win = x[k : k + n]
            for a in range(len(w) - len(win) + 1):
                if w[a : a + len(win)] == win:
                    hit |= set(range(a, a + len(win)))
                    ids.add(i)
    return len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)


def data():
    rng = random.Random(11)
    vocab = ["the", "The", "of", "ÀB", "àb", "x1", "été", "run"] + [f"v{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randrange(1, 30)))) for k in range(12)]
    items += [(50, "Ünique one"), (51, ""), (52, None), (None, "the of"), (53, "..."), (50, "again"), (54, items[0][1])]
    docs = [(1, None), (2, ""), (3, "-- " + items[3][1].upper() + " --"), (4, "the " * 30_000), (5, items[1][1] + " " + items[1][1]), (5, items[1][1]), (None, items[2][1]), (6, "ünique one"), (7, "Ünique, one!")]
    for k in range(60):
        body = rng.choices(vocab, k=rng.randrange(1, 200))
        x = words(rng.choice(items)[1])
        at = rng.randrange(len(body))
        body[at:at] = x[: rng.choice([5, 13, 20])]
        docs.append((100 + k, rng.choice([" ", ", ", "\n"]).join(body)))
    return docs, items


def brute_near(docs, items, n=13, slop=3):
    """Windows and items whose terms all stand within reach of a place of the rarest one, by document."""
    freq = Counter(w for _, t in docs for w in words(t))
    wins = {}
    for i, t in items:
        x = words(t)
        for k in range(max(1, len(x) - n + 1) if x and i is not None else 0):
            wins.setdefault(tuple(x[k : k + n]), set()).add(i)
    out = []
    for _, t in docs:
        at = {}
        for k, w in enumerate(words(t)):
            at.setdefault(w, []).append(k)
        found, ids = 0, set()
        for win, of in wins.items():
            rarest = min(set(win), key=lambda w: (freq[w], w))
            reach = max(1, len(win) - 1 + slop)
            if all(w in at for w in win) and any(all(any(abs(p - q) <= reach for q in at[w]) for w in set(win)) for p in at[rarest]):
                found += 1
                ids |= of
        out.append((found, sorted(ids)))
    return out


@pytest.mark.parametrize("block", [d.BLOCK, 40])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK", block)
    docs, items = data()
    df = spark.createDataFrame([(i, t, "clash", -1) for i, t in docs], "doc_id long, text string, items string, n_hit int").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.n_items, r.contaminated, r.n_near, tuple(r.near_items)) for r in d.contamination(df, bench, slop=3).collect())
    want = Counter()
    for (i, t), (n_near, near) in zip(docs, brute_near(docs, items), strict=True):
        n, hit, ids, bad = brute(t, items)
        want[i, n, hit, tuple(ids), len(ids), bad, n_near, tuple(near)] += 1
    assert got == want


def test_equal_rows_and_hot_terms(spark):
    """Rows without id and with one text are judged alike and count once in the index; a term that fills a text has one list."""
    item = "x x y " * 5
    docs = spark.createDataFrame([(None, "a " + item)] * 30 + [(1, "x " * 5000), (2, "y x " * 3000)], "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_hit, r.n_items, r.n_near > 0) for r in d.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), slop=2).collect())
    assert got == {(None, 15, 1, True): 30, (1, 0, 0, False): 1, (2, 0, 0, True): 1}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha beta"), (4, "alpha a b c d e beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    assert {r.doc_id for r in d.matches(docs, bench, ["doc_id"], slop=2)[0].collect()} == {1, 2}
    assert d.matches(docs, bench, ["doc_id"])[0].count() == 0


def test_postings(spark):
    docs = spark.createDataFrame([(1, ", The cat the"), (2, "cat"), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("the",), ("cat",), ("dog",)], "term string")
    got = {(r.doc_id, r.term): r["at"] for r in d.postings(docs, terms, ["doc_id"]).collect()}
    assert got == {(1, "the"): [0, 2], (1, "cat"): [1], (2, "cat"): [0]}


def test_number_of_words(spark):
    texts = [None, "", "...", "a", " a", "a ", ".a,b.", "a" * 9 + "..b", "\x00", "é.É\x00"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_words for r in d.contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect()}
    assert got == {k: len(words(t)) for k, t in enumerate(texts)}


def test_cleaned(spark):
    docs, items = data()
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, _k1 string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.text) for r in d.cleaned(df.drop("_k1"), bench).collect())
    assert got == Counter((i, t) for i, t in docs if not brute(t, items)[1])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert d.contamination(docs.where("false"), bench).count() == 0
    assert [(r.n_hit, r.contaminated) for r in d.contamination(docs, bench.where("false")).collect()] == [(0, False)]
    assert [(r.n_hit, r.contaminated) for r in d.contamination(docs, bench).collect()] == [(2, True)]
