from tessera.llm import preference as p


def show(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def brute(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1

    def spans(turns):
        out, at = [], 0
        for r, t in turns:
            start, end = at + len(r) + 5, at + len(show([(r, t)]))
            out += [(start, end)] * (r == "assistant")
            at = end
        return out

    return n, show(a[:n]), show(a[n:]), spans(a[n:]), show(b[n:]), spans(b[n:])


def test_against_brute_force(spark):
    u, v, w = ("user", "hé 😀"), ("assistant", "yes"), ("assistant", "")
    cases = [([u, v], [u, w]), ([u, v], [u, v]), ([], [u]), (None, [v]), ([u], None), ([v, u, v, u], [v, u, w]), ([("", "x" * 100_000)], [u]), ([u, v], [u])]
    rows = [(k, [*map(list, a)] if a is not None else None, [*map(list, b)] if b is not None else None, "clash") for k, (a, b) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"id long, chosen {p.TURNS}, rejected {p.TURNS}, prompt string")
    for r in p.formatted(df).collect():
        a, b = cases[r.id]
        got = (r.n_prefix, r.prompt, r.chosen, [tuple(x) for x in r.chosen_spans], r.rejected, [tuple(x) for x in r.rejected_spans])
        assert got == brute(a or [], b or [])


def test_ranks(spark, monkeypatch):
    monkeypatch.setattr(p, "SEGMENT", 2)
    rows = [(1, 1, "b", "y"), (1, 0, "a", "x"), (1, 0, "a", "x"), (1, 0, "a", "w"), (1, 2, None, None), (None, 1, "q", "q"), (2, None, "q", "q"), (0, -5, "z", "last")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "conv_id long, turn long, role string, text string, segment int, rank int").repartition(3)
    got = {(r.conv_id, r.rank): (*r.t, r.total) for r in p.ranked(df).collect()}
    assert got == {(1, 0): ("a", "w", 3), (1, 1): ("b", "y", 3), (1, 2): ("", "", 3), (0, 0): ("z", "last", 1)}
    pairs = {(r.conv_id, r.rank): r.rejected and tuple(r.rejected) for r in p.sampled(df).collect()}
    assert pairs == {(1, 0): ("a", "w"), (1, 1): ("b", "y"), (1, 2): ("z", "last"), (0, 0): ("", "")}
    assert p.formatted(p.compared(p.sampled(df.where("false")))).count() == 0


def test_more_turns_than_a_page(spark):
    """4,097 turns and more: one prefix for the conversation, whatever the turn numbers."""
    n = p.SEGMENT + 10
    rows = [(6, k, "user", f"t{k}") for k in range(n)] + [(7, 4090 + k, "assistant", f"t{k}") for k in range(11)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r.conv_id, r.segment): r for r in p.formatted(p.compared(p.sampled(df)), shared="shared").collect()}
    assert set(got) == {(6, 0), (6, 1), (7, 0)}
    assert [got[6, s].whole for s in (0, 1)] == [n - 1, n - 1] and got[7, 0].whole == 10
    assert got[6, 0].prompt + got[6, 1].prompt == show([("user", f"t{k}") for k in range(n - 1)])
    assert (got[6, 0].chosen, got[6, 1].chosen, got[6, 1].rejected) == ("", show([("user", f"t{n - 1}")]), show([("assistant", "t10")]))


def test_long_conversations_pair_as_a_whole(spark, monkeypatch):
    from tessera.llm import queries

    monkeypatch.setattr(p, "SEGMENT", 2)
    a = [("user" if k % 2 else "assistant", f"a{k}") for k in range(5)]
    b = [("user", "b0"), ("assistant", "b1")]
    same = [("user", "s"), ("assistant", "t"), ("user", "end")]
    whole = {0: a, 1: b, 4: same, 5: same[1:], 7: a[:1]}
    rows = [(i, 10_000 * k + i, r, t) for i, c in whole.items() for k, (r, t) in enumerate(c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = {(r.conv_id, r.segment): r for r in queries.op9_preference(spark, "").collect()}
    for i, c in whole.items():
        n, prompt, chosen, _, rejected, _ = brute(c, c[:-1] + whole.get(i ^ 1, [])[-1:])
        parts = [got[i, k] for k in range((len(c) + 1) // 2)]
        assert [r.n_prefix for r in parts] == [n] * len(parts)
        assert ["".join(getattr(r, x) for r in parts) for x in ("prompt", "chosen", "rejected")] == [prompt, chosen, rejected]
    assert len(got) == sum((len(c) + 1) // 2 for c in whole.values())
