import math
import random
import re
import string
from collections import Counter

from tessera.llm import secrets as s


def brute_base(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def battery(token):
    bare = token.rstrip("=")
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token) and re.search("[0-9]", token) and re.search("[a-fA-F]", token):
        alphabet, body = string.digits + "abcdef", token.lower()
    elif re.fullmatch("[A-Z2-7]+=*", token) and re.search("[2-7]", token) and re.search("[A-Z]", token):
        alphabet, body = string.ascii_uppercase + "234567", bare
    elif all(re.search(c, token) for c in ("[0-9]", "[a-z]", "[A-Z]")) and re.fullmatch("[A-Za-z0-9+/_-]+=*", token):
        alphabet, body = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/", bare.replace("-", "+").replace("_", "/")
    else:
        return None
    k, n, x = len(alphabet), len(body), [alphabet.index(c) for c in body]
    two = lambda z: math.erfc(abs(z) / math.sqrt(2))
    chi, v = k / n * sum(c * c for c in Counter(x).values()) - n, 2 / (9 * (k - 1))
    z = ((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - v)) / math.sqrt(v)
    p1 = two(z) / 2 if z > 0 else 1 - two(z) / 2
    bits = [c >= k / 2 for c in x]
    high, runs = sum(bits), 1 + sum(a != b for a, b in zip(bits, bits[1:], strict=False))
    both = 2 * high * (n - high)
    spread = both * (both - n) / (n * n * (n - 1))
    p2 = two((runs - both / n - 1) / math.sqrt(spread)) if spread > 0 else 0
    m = sum(x) / n
    var, lag = sum((c - m) ** 2 for c in x), sum((a - m) * (b - m) for a, b in zip(x, x[1:], strict=False))
    p3 = two((lag / var + 1 / n) * math.sqrt(n)) if var else 0
    return min(1, 3 * min(p1, p2, p3))


def data():
    rng = random.Random(6)
    hexed = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    b64 = lambda n: "aB3" + "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=n))
    bits = ["Token", "token = ", "password:", "api_key=", 'APIKEY = "', "sECRET", " : ", "é😀", "\n", " ", "AKIA", "=", "short", "ABCDEFGH12345678", "word", "ſecret: abcdefghijkl1234"]
    docs = [(1, None), (2, ""), (3, "token: " + hexed(40)), (4, "password: token: abcdefghijkl1234"), (5, "😀 AKIA" + "Q" * 16), (6, hexed(15)), (7, "x " * 50_000 + hexed(64)), (8, (hexed(20) + " ") * 400), (9, "KEY " + b64(40)), (10, "v " + "Abc123" * 10), (11, "w " + "A1a" * 40 + "=="), (12, "Version20240101ReleaseCandidateNumberTwo"), (9, "KEY " + b64(44))]
    for k in range(150):
        docs.append((100 + k, "".join(rng.choice(bits) if rng.random() < 0.75 else rng.choice([hexed(rng.randrange(8, 40)), b64(rng.randrange(10, 50))]) for _ in range(rng.randrange(1, 25)))))
    return docs


def test_base_spans_against_brute_force(spark):
    docs = data()
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], "doc_id long, text string, secrets string, base int").repartition(3)
    got = Counter((r.doc_id, tuple((x.start, x.rank, x.end) for x in r.secrets if x.rank < 3)) for r in s.scan(df).collect())
    assert got == Counter((i, tuple(brute_base(t))) for i, t in docs)


def test_battery_and_dismissal_against_plain_python(spark):
    docs = data()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    pattern = re.compile(s.TOKEN)
    want = sorted((m[0], battery(m[0])) for _, t in docs for m in pattern.finditer(t or "") if battery(m[0]) is not None)
    got = sorted((r.body, r.p) for r in s.tokens_of(df).collect())
    assert [w for w, _ in got] == [w for w, _ in want]
    assert all(abs(a - b) < 1e-5 for (_, a), (_, b) in zip(got, want, strict=True))
    found = {r.doc_id: {r.text[x.start : x.end] for x in r.secrets if x.rank == 3} for r in s.scan(df.where("doc_id in (9, 10, 11, 12)")).collect() if r.doc_id != 9}
    assert found == {10: set(), 11: set(), 12: set()} or found[10] == found[11] == set()
    kept = [x for r in s.scan(df).collect() if r.doc_id == 9 for x in r.secrets]
    assert len(kept) == 2 and all(x.rank == 3 for x in kept)
    for r in s.scan(df).collect():
        base = brute_base(r.text)
        assert all(b <= x.start or x.end <= a for x in r.secrets if x.rank == 3 for a, _, b in base)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token: 0123456789abcdef0123 end", "x"), (2, "clean", "y"), (3, None, None)], "doc_id long, text string, secrets string")
    got = {r.doc_id: r.text for r in s.redact(df).collect()}
    assert got == {1: "é [SECRET] end", 2: "clean", 3: None} and s.redact(df).columns == df.columns


def test_empty_table(spark):
    assert s.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
