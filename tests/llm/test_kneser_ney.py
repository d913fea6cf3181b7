import math
import pathlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import kneser_ney as kn

END = object()


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


def brute(rows, order):
    """The model's formulas over dictionaries."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    train = [words(t) for i, t in rows if not held[i]]
    uni = Counter(w for d in train for w in d)
    n, v = sum(uni.values()), len(uni)
    padded = lambda d: [None] * (order - 1) + d
    level = {order: Counter(tuple(padded(d)[k : k + order]) for d in train for k in range(len(d)))}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    kinds = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    cuts = {k: kn.discounts(kinds(level[k])) for k in level}
    cut = lambda c, k: cuts[k][min(c, 3) - 1] if c else 0
    after = {k: defaultdict(list) for k in level}
    for k, c in level.items():
        for g, x in c.items():
            after[k][g[:-1]].append(x)

    def p(context, w):
        k = len(context) + 1
        below = p(context[1:], w) if k > 1 else 1 / (v + 1)
        if context not in after[k]:
            return below
        c, total = level[k][(*context, w)], sum(after[k][context])
        return max(c - cut(c, k), 0) / total + sum(cut(x, k) for x in after[k][context]) / total * below

    out = {}
    for i, t in rows:
        d = words(t)
        s = sum(math.log10(p(tuple(padded(d)[k : k + order - 1]), d[k])) for k in range(len(d)))
        out[i] = (held[i], len(d), sum(uni[w] > 0 for w in d), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in d), s)
    return out, p, [*uni, "unseen"]


def data():
    rng = np.random.default_rng(4)
    vocab = ["the", "The", "of", "é", "naïve", "x", "long" * 30] + [f"w{k}" for k in range(200)]
    rows = [(1, None), (2, ""), (3, "\t\n "), (4, "one"), (5, "one one one"), (6, "the of " * 3000), (7, "a\x00b c")]
    return rows + [(10 + k, " ".join(rng.choice(vocab, int(rng.integers(1, 120)), p=None))) for k in range(150)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_against_dictionaries(spark, order):
    rows = data()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    want, p, types = brute(rows, order)
    got = kn.fit_and_score(df, order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4]) and r.score == pytest.approx(w[5])
    none = (None,) * (order - 1)
    for context in [none, (*none, "the")[1:], (*none, "the", "of")[-(order - 1) :], (*none, "unseen")[1:]]:
        assert sum(p(context, w) for w in types) == pytest.approx(1)


def test_hot_contexts_are_dealt_out(spark):
    """A third of all bigrams follow one context: its n-grams lie in several shards, and its totals are whole."""
    rows = [(k, " ".join(f"a r{k}x{j} b" for j in range(40))) for k in range(40)] + [(100 + k, f"q{k} z") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, *_ = brute(rows, 3)
    model = kn.fit(df.where(~kn.held_out()), shards=16)
    a = model.words(np.array([x for _, h, _ in kn.token_hashes(pa.array(["a"])) for x in h[:1]]))[0]
    assert model.is_hot(a).all() and len({p.name.split(".")[0] for p in pathlib.Path(model.path).glob("gram2-*") if np.load(p).size}) > 4
    for r in kn.score(df, model).collect():
        assert r.score == pytest.approx(want[r.doc_id][5])


def test_packed_columns_and_tables():
    rng = np.random.default_rng(1)
    cols = [rng.integers(0, top, 1000).astype(np.uint64) for top in (1, 200, 70_000, 2**40)]
    assert all((a == b).all() for a, b in zip(cols, kn.unpack(kn.pack(cols)), strict=True))
    wide = [c.astype(np.uint64) + np.uint64(2**33) for c in cols[:3]]
    distinct, counts = kn.grouped(wide, np.ones(1000, np.int64))
    assert Counter(zip(*[c.tolist() for c in wide], strict=True)) == dict(zip(zip(*[c.tolist() for c in distinct], strict=True), counts.tolist(), strict=True))


def test_no_training_rows_and_empty_table(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = kn.fit_and_score(df).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0, 0)
    assert kn.fit_and_score(df.where("false")).count() == 0


def test_more_shards_than_hot_contexts(spark):
    """Shards into which nothing of some kind has fallen."""
    rows = [(k, " ".join(f"a b r{k}x{j}" for j in range(30))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, *_ = brute(rows, 3)
    for r in kn.score(df, kn.fit(df.where(~kn.held_out()), shards=50)).collect():
        assert r.score == pytest.approx(want[r.doc_id][5])
