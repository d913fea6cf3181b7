import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, docs, reference, window=2048):
    """Every id lies in one piece, offsets are gapless, and no sequence needs padding."""
    want = {i: reference(t) for i, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids == ids and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0


def test_round_trip(spark, reference):
    rng = np.random.default_rng(2)
    words = ["the", " ", "naïve", "x1y2", "\n\n", "don't", "日本語", "  ", "<|endoftext|>", "123456", "é" * 9]
    docs = [(1, None), (2, ""), (3, "a" * 50_000), (4, " " * 5000), (5, "same"), (6, "same"), (7, "a <|endoftext|> b"), (8, "<|endoftext|><|endoftext|>x"), (9, "<|endoftext|")]
    docs += [(10 + k, " ".join(rng.choice(words, int(rng.integers(0, 900))))) for k in range(80)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, start int, ids string").repartition(3)
    for shard in (3000, 1 << 20):
        check(packing.pack(df, PATH, shard_tokens=shard).collect(), docs, reference)


def test_plain_library_ids(reference):
    spec = open(PATH, encoding="utf-8").read()
    bpe = packing.ByteBpe(spec)
    assert bpe("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    texts = ["", "x <|endoftext|>", "\r\n\t it's  we'll  ÀÉ ﷽ 12e5", " " * 300_000 + "a", "\u2028a\u00a0 b"]
    assert [bpe(t).tolist() for t in texts] == [reference(t)[:-1] for t in texts]
    # a file of another make is left to the library
    assert packing.ByteBpe(spec.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))._fast is None


def test_routing_brings_relatives_together(spark):
    """Families that share rare words stand far apart in the table and meet in one shard."""
    rng = np.random.default_rng(5)
    common = [f"common{k}" for k in range(300)]
    docs = []
    for member in range(8):
        for family in range(30):
            own = [f"{chr(97 + family % 26)}{family}q{k}zx" for k in range(30)]
            docs.append((member * 30 + family, " ".join([*rng.choice(own, 60), *rng.choice(common, 40)])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8, "doc_id")
    rows = packing.pack(df, PATH, window=1024, shard_tokens=1 << 13).collect()
    with_ = defaultdict(set)
    for r in rows:
        with_[r.sequence_id].add(r.doc_id % 30)
    assert np.mean([len(x) for x in with_.values()]) < 2.5  # a window holds about four documents


def test_equal_rows_spread(spark):
    df = spark.createDataFrame([(None, "the same words again")] * 400, "doc_id long, text string")
    ranges, _ = packing.routed(df, PATH)
    assert ranges.count() == 400
    assert sum(r.length for r in packing.pack(df, PATH, window=64).collect()) == 400 * 5


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_neighbours_come_by_bm25():
    a, b = np.arange(10, 20, dtype=np.uint32), np.arange(30, 40, dtype=np.uint32)
    pieces = [a, b, np.append(b[:5], 99), np.append(a[:5], 99), a[::-1].copy()]
    found = packing.Shard([*pieces, *(np.array([60 + k], np.uint32) for k in range(3))], 100).best(0, np.array([True] + [False] * 7))
    assert list(found) == [4, 3]
    pieces += [np.array([60 + k], np.uint32) for k in range(3)]
    rows = list(packing.pack_shard([len(p) for p in pieces], pieces, 16, 100))
    assert [r for r, _, _, q, _ in rows if q == 0] == [0, 4]


def test_scores_against_the_formula():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 60, int(rng.integers(1, 80))).astype(np.uint32) for _ in range(40)]
    index, mean = packing.Shard(docs, 60), np.mean([len(d) for d in docs])
    for seed in range(40):
        score = {}
        for k, d in enumerate(docs):
            if k == seed:
                continue
            total = 0.0
            for t in set(docs[seed].tolist()) & set(d.tolist()):
                df = sum(t in x for x in docs)
                tf = int((d == t).sum())
                total += max(0, np.log((40 - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
            if total:
                score[k] = total
        used = np.zeros(40, bool)
        used[seed] = True
        found = list(index.best(seed, used, 3))
        assert set(found) == set(score)
        got = [score[k] for k in found]
        assert all(a >= b - 1e-9 for a, b in zip(got, got[1:], strict=False))
