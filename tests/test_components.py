import random

import pytest

from tessera.operators import components
from tessera.operators.components import connected_components


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 30)]
    rows = chain + star + [(7, 3), (500, 500), (600, None), (601, 602), (602, 601), (601, 602)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {500: 500, 601: 601, 602: 601}


def test_hubs(spark):
    """Stars far over the share of a hub, joined by a chain, with leaves below and above their hubs."""
    rows = [(5000, k) for k in range(1, 900)] + [(6000, 7000 + k) for k in range(900)] + [(899, 8001), (8001, 6000), (9000, 9001)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    nodes = {x for e in rows for x in e}
    assert got == {n: 9000 if n >= 9000 else 1 for n in nodes}


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def spread(edges):
    """The least node of each node's component, by search."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = start
                todo += near[x]
    return out


@pytest.mark.parametrize("most", [0, 5, 40, 1_000_000])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_any_bound(spark, monkeypatch, most, kind):
    """One task, many chunks a task or rounds: the components are the same, each node comes once."""
    rng = random.Random(most)
    rows = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(k, k) for k in (100, 100, 101, -3)] + [(200 + k, 201 + k) for k in range(20)]
    rows = [(str(a), str(b)) if kind == "string" else (a, b) for a, b in rows]
    monkeypatch.setattr(components, "LINKS", most)
    found = connected_components(spark.createDataFrame([*rows, (None, rows[0][0])], f"src {kind}, dst {kind}").repartition(3)).collect()
    assert sorted((r.node, r.component) for r in found) == sorted(spread(rows).items())


def test_few_jobs(spark):
    """However long its chains are, a graph that one task can hold isn't joined round by round."""
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    edges = spark.createDataFrame([(k, k + 1) for k in range(3000)], "src long, dst long")
    before = jobs()
    assert connected_components(edges).where("component = 0").count() == 3001
    assert jobs() - before <= 8
