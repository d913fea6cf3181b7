import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import quality_gbt as q

SCHEMA = "doc_id long, text string, lang string, score double"


def test_walk_equals_plain_descent():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    t = q.train(x, y, rounds=25)

    def one(row):
        raw = t.prior
        for node in t.roots:
            while t.feature[node] >= 0:
                node = t.left[node] + (row[t.feature[node]] > t.threshold[node])
            raw += t.value[node]
        return 1 / (1 + np.exp(-raw))

    p = t.predict(x)
    assert np.allclose(p, [one(r) for r in x])
    assert ((p > 0.5) == y).mean() > 0.95


def test_features_do_not_depend_on_the_batch():
    texts = ["", None, "One two two.\nOne two two.\n", "a" * 100_000, "ÉÉ !! | ##", " \n", "x"]
    whole = q.features_of(pa.array(texts))
    assert whole.shape == (len(texts), len(q.FEATURES)) and np.isfinite(whole).all()
    assert np.array_equal(whole, np.concatenate([q.features_of(pa.array([t], pa.string())) for t in texts]))
    named = dict(zip(q.FEATURES, whole[2], strict=True))
    assert named["distinct_lines"] == 0.5 and abs(named["distinct_words"] - 0.5) < 1e-6
    assert not whole[0][1:].any() and not whole[1][1:].any()


def test_held_out_accuracy_and_edges(spark):
    rng = np.random.default_rng(1)
    words = ["plain", "words", "stand", "here", "quietly"]
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        body = [str(w) + ("" if good else rng.choice(["###", "!!", " |"])) for w in rng.choice(words, 30)]
        rows.append((i, " ".join(body), "en", 0.0))
        labels.append((i, int(good), 0))
    rows += [(1000, None, None, None), (1001, "", "en", 0.0), (1002, "z" * 200_000, "en", 0.0)]
    labels += [(1000, None, 0), (0, 0, 0), (None, 1, 1)]
    docs, marks = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = q.score(docs, q.fit(docs, marks)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in held) / len(held) > 0.95


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "x", 0.0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.score(docs, q.fit(docs, none)).first().score == 0.5
    assert q.score(docs.where("false"), q.fit(docs.where("false"), none)).count() == 0


def test_repeated_rows_ties_and_clashes(spark):
    """Repeats and the order of rows change nothing; equal texts score alike."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["good", "words", "here"] if i % 2 else ["###", "||", "&&"], 20))) for i in range(120)]
    marks = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    once = spark.createDataFrame([(i, t, -1, True) for i, t in rows], "doc_id long, text string, predicted int, held_out boolean")
    again = once.unionByName(once.where("doc_id % 3 = 0")).repartition(5, "text")
    a = {r.doc_id: r.score for r in q.score(once, q.fit(once, marks)).collect()}
    b = q.score(again, q.fit(again, marks)).collect()
    assert len(b) == again.count() and all(a[r.doc_id] == r.score for r in b)
    same = spark.createDataFrame([(1, "tie text"), (2, "tie text"), (None, "tie text")], "doc_id long, text string")
    assert len({r.score for r in q.score(same, q.fit(once, marks)).collect()}) == 1
