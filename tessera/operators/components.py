"""Connected components: forests in the tasks, then one task, or alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import reach
from ..storage import discard, materialise

#: A node with more than one in so many edges is a hub; so there are at most twice as many hubs.
SHARE = 100
#: Edges that one task joins, and that a task thins at once: some 200 MB.
LINKS = 1_000_000


def _with_low(rows: DataFrame, low: DataFrame, edges: int) -> DataFrame:
    """``rows`` with the ``low`` of their src. Hubs' values are broadcast (at most 2 * ``SHARE`` rows), so a hub's edges stay where they are."""
    limit = max(16, edges // SHARE)
    hubs = F.broadcast(low.where(F.col("n") > limit).select(F.col("src").alias("_hub"), F.col("low").alias("_low")))
    told = rows.join(hubs, F.col("src") == F.col("_hub"), "left")
    large = told.where("_hub is not null").select("src", "dst", F.col("_low").alias("low"))
    rest = told.where("_hub is null").select("src", "dst")
    return large.unionByName(rest.join(low.select("src", "low"), "src").select("src", "dst", "low"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"), F.count("*").alias("n"))
    return _with_low(both.where("dst > src"), low, n).select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src != dst")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("n"))
    moved = _with_low(down, low, n).select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src != dst")
    return moved.unionByName(low.select("src", F.col("low").alias("dst"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (src, dst); a component is named by its least node.

    Edges are thinned to forests in the tasks that read them. One task joins
    what is left, up to ``LINKS`` edges; more take rounds. Every round is two
    hash aggregations and two equi-joins, whose hubs are joined without moving
    their edges. Its result is written to the shared folder, and only a count
    and a checksum reach the driver. Rounds grow with the logarithm of a
    component's diameter. Self-loops make a node a component of its own; null
    ends and repeated edges don't matter.
    """
    most = LINKS
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    edges = materialise(edges.mapInArrow(lambda b: reach.thinned(b, max(2, most), reach.joined), edges.schema), "cc")
    if edges.count() <= most:
        kind = edges.schema["src"].dataType
        schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])
        found = materialise(edges.repartition(1).mapInArrow(reach.members, schema), "cc-members")
        discard(edges)
        return found
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    state, seen, before = edges.where("src != dst"), None, None
    for _ in range(max_rounds):
        mark = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(src, dst))")).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        stars = materialise(_large_star(state, mark[0]), "cc-star")
        discard(before)
        state = before = materialise(_small_star(stars, mark[0]), "cc")
        discard(stars)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = state.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    found = state.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
    return found.unionByName(loops.join(found, "node", "left_anti"))
