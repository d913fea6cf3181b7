import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component string"


def brute_print(text: str | None) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints: dict[int, int]) -> dict[int, int]:
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in prints}


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gämma", "d", "ÉCOLE", "omega", "x" * 40]
    base = " ".join(rng.choice(words, 300))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "two words"), (7, base), (8, base + " tail"), (9, base.upper()), (10, base.replace(" ", "\n\t")), (11, "A" * 200_000), (12, base * 40)]
    rows += [(100 + k, base + " " + str(k)) for k in range(30)] + [(200 + k, " ".join(rng.choice(words, 6))) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    groups = brute_components(prints)
    assert got == {i: (prints[i], groups[i]) for i in prints}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
def test_bit_sliced_equals_popcount(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**64, 150, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k % 9, replace=False)) for k in range(150)], np.uint64)
    b = np.concatenate([a ^ flips, rng.integers(0, 2**64, 37, dtype=np.uint64)])
    i, j = simhash.within(a, simhash.planes(b), len(b), radius)
    want = {(x, y) for x in range(len(a)) for y in range(len(b)) if bin(int(a[x] ^ b[y])).count("1") <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_parts_of_a_hot_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 8)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = np.random.default_rng(1)
    seed = int(rng.integers(0, 2**62))
    prints = sorted({seed ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60))) for _ in range(60)} | {int(x) for x in rng.integers(0, 2**62, 40)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in simhash.fingerprint_links(df, len(prints)).collect():
        assert bin(r.src ^ r.dst).count("1") <= 3
        root[find(r.src)] = find(r.dst)
    want = brute_components({p: p for p in prints})
    assert len({find(p) for p in prints}) == len(set(want.values()))
    assert all((find(p) == find(q)) == (want[p] == want[q]) for p in prints for q in prints)


def brute_similar(a: str, b: str, shingle: int = 5) -> float:
    def cut(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(rng, text: str, n: int) -> str:
    w = text.split()
    for k in rng.choice(len(w), n, replace=False):
        w[k] = f"new{rng.integers(10**6)}"
    return " ".join(w)


def test_similar_groups_catch_near_copies_and_spare_others(spark):
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 4000, n))
    rows, pairs = [(1, None), (2, "")], []
    for k in range(60):
        text = say(250)
        rows += [(10 * k + 10, text), (10 * k + 11, edited(rng, text, 1 + k % 6)), (10 * k + 12, edited(rng, text, 40))]
        pairs += [(10 * k + 10, 10 * k + 11), (10 * k + 10, 10 * k + 12), (10 * k + 11, 10 * k + 12)]
    texts = dict(rows)
    origin = say(200)
    hot = [(5000 + k, edited(rng, origin, 2)) for k in range(150)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows + hot + [(10, rows[2][1])]], "doc_id long, text string, component_id string")
    found = simhash.similar_groups(docs).cache()
    assert {r.doc_id for r in found.where("first").collect()} == {r.component_id for r in found.collect()}
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert found.count() == docs.count() and got[1] == got[2] == 1
    true = {p for p in pairs if brute_similar(texts[p[0]], texts[p[1]]) >= 0.8}
    assert len(true) >= 50 and sum(got[a] == got[b] for a, b in true) >= 0.95 * len(true)
    assert not any(got[a] == got[b] for a, b in pairs if (a, b) not in true)
    assert len({got[i] for i, _ in hot}) <= 3
    assert simhash.similar_groups(docs.limit(0)).count() == 0


def test_similar_groups_are_all_components_of_verified_pairs(spark):
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 4000, n))
    hub, texts = say(60), {}
    texts |= {1000 + k: edited(rng, hub, 1) for k in range(300)} | {2000: hub}  # copies are similar to the hub only
    for k in range(60):
        short = say(30)
        texts |= {3000 + 2 * k: short, 3001 + 2 * k: short + " end"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    cut = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    for i in texts:
        for j in texts:
            if i < j and (len(cut[i] & cut[j]) >= 0.8 * len(cut[i] | cut[j]) or (prints[i] ^ prints[j]).bit_count() <= 3):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in texts} and len({got[i] for i in texts if i <= 2000}) == 1


@pytest.mark.parametrize("rows", [simhash.ROWS, 40])
def test_a_large_family_of_unlike_relatives(spark, monkeypatch, rows):
    """Many copies of one text around the threshold, in buckets that are dealt out in parts: every similar pair is joined, no other."""
    monkeypatch.setattr(simhash, "ROWS", rows)
    rng = np.random.default_rng(12)
    origin = " ".join(f"w{k}" for k in rng.integers(0, 4000, 120))
    texts = {k: edited(rng, origin, 1 + k % 9) for k in range(220)}
    texts |= {1000 + k: origin + " " + " ".join(f"u{k}x{x}" for x in range(10 * k)) for k in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    cut = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and (len(cut[i] & cut[j]) >= 0.8 * len(cut[i] | cut[j]) or (prints[i] ^ prints[j]).bit_count() <= 3):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in texts} and len(set(got.values())) > 2


def test_representatives(spark):
    say = lambda k: " ".join(f"v{k}x{j}" for j in range(60))
    rows = [(1, say(1), "b"), (1, say(1), "a"), (1, say(2), "c"), (2, say(2), "d"), (None, say(2), "e"), (None, say(3), "f"), (None, say(3), "g"), (4, None, "h"), (3, "", "i"), (5, say(1) + " tail", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string").repartition(3)
    assert sorted(r.first for r in simhash.representatives(docs).collect()) == ["a", "c", "f", "i"]
    assert simhash.representatives(docs).columns == docs.columns


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(0)
    for n in (3, 64, 65, 130, 1000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[n // 8 :], rng.integers(0, 2**63, n // 8).astype(np.uint64))))
        c = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sets = [a, b, c, a[: max(1, int(0.9 * len(a)))]]
        bucket = simhash.Bucket(np.array([len(x) for x in sets]), [simhash.parity(x, len(x)) for x in sets], 0.7)
        found = {tuple(sorted((i, j))) for i in range(4) for j in bucket.partners(i).tolist()}
        alike = {(i, j) for i in range(4) for j in range(i + 1, 4) if len(np.intersect1d(sets[i], sets[j])) >= 0.7 * len(np.union1d(sets[i], sets[j]))}
        assert alike <= found and (n < 100 or not any(2 in pair for pair in found))


def test_shingle_sets_equal_sets_of_words():
    import pyarrow as pa

    texts = ["a b c d e f", "A b C d e F", "b c d e f", "a b", "ab", "", None, "é x " * 9, "x " * 9]
    sets = [set(x.tolist()) for x in simhash.shingle_sets_of(pa.array(texts))]
    for a, x in zip(texts, sets, strict=True):
        for b, y in zip(texts, sets, strict=True):
            assert (len(x & y) / len(x | y) if x | y else 1.0) == brute_similar(a, b)
