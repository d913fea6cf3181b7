"""Graph operators over edge tables: traversal, paths, cycles, fan-in and fan-out.

Traversals run level by level as equi-joins with an anti-join against what was
reached; every level is written to the shared folder, and only an emptiness
flag reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import reach
from ..storage import discard, materialise

NO_LIMIT = 1 << 30
#: Links that one task searches for components by itself.
LOCAL = 1_000_000
#: Rows of a table of nodes that is broadcast.
NODES = 500_000


def by_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes``, broadcast in joins if there are at most ``NODES``: then the edges that they meet don't move."""
    return F.broadcast(nodes) if nodes.count() <= NODES else nodes


def _links(edges: DataFrame, src: str, dst: str, direction: str) -> DataFrame:
    order = F.col("seq") if "seq" in edges.columns else F.lit(0).cast("long")
    out = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"), order.alias("seq"))
    back = edges.select(F.col(dst).alias("u"), F.col(src).alias("v"), order.alias("seq"))
    both = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return both.groupBy("u", "v").agg(F.min("seq").alias("seq"))


def numbered(rows: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """``rows`` with a running number from 0 by ``order``: ranges are numbered by themselves and shifted by the rows before them, of which the driver sees one number a range."""
    placed = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before, starts = 0, []
    for r in sorted(placed.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        starts.append((r["_part"], before))
        before += r["count"]
    base = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _base long"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_in", inside).join(base, "_part").withColumn(name, F.col("_base") + F.col("_in")).drop("_part", "_in", "_base")


def found_enough(levels: list[DataFrame], limit: int) -> bool:
    """Whether every origin has ``limit`` nodes or no way on."""
    seen = levels[0]
    for x in levels[1:]:
        seen = seen.unionByName(x)
    open_ = levels[-1].select("origin").distinct().join(seen.where("depth > 0").groupBy("origin").count().where(F.col("count") < limit), "origin", "left_semi")
    return open_.isEmpty()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = NO_LIMIT, direction: str = "out", limit: int | None = None, src: str = "from_path", dst: str = "to_path", goal: str | None = None) -> DataFrame:
    """(origin, node, depth, parent, place) of every node reached from ``seeds`` (origin, node), the seeds at depth 0.

    A level holds no paths, only the node that found each node, and meets what is
    known in one anti-join. With ``limit`` or ``goal`` levels are numbered by
    (the parent's place, the edge's number), as a queue that takes edges in the
    order of ``seq`` meets nodes, so ties fall as in one; else ``place`` is 0 and
    the parent the least. ``limit`` bounds the nodes found for each origin, seeds
    not counted; with ``goal`` the search ends with the level that holds it.
    """
    in_order = limit is not None or goal is not None
    links = materialise(_links(edges, src, dst, direction), "links")
    none = F.lit(None).cast(links.schema["u"].dataType)
    level = materialise(seeds.select("origin", "node").distinct().select("origin", "node", F.lit(0).alias("depth"), none.alias("parent"), F.lit(0).cast("long").alias("place")), "bfs")
    levels = [level]
    for d in range(1, depth + 1):
        m = F.struct("place", "seq", F.col("u").alias("parent")) if in_order else F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("seq"), F.col("u").alias("parent"))
        step = level.join(links, level["node"] == links["u"]).select("origin", F.col("v").alias("node"), m.alias("m")).groupBy("origin", "node").agg(F.min("m").alias("m"))
        known = levels[0].select("origin", "node")
        for x in levels[1:]:
            known = known.unionByName(x.select("origin", "node"))
        fresh = step.join(known, ["origin", "node"], "left_anti").select("origin", "node", F.lit(d).alias("depth"), "m.parent", "m.place", "m.seq")
        fresh = numbered(fresh.withColumnRenamed("place", "_before"), ["_before", "seq", "origin", "node"], "place") if in_order else fresh
        level = materialise(fresh.select("origin", "node", "depth", "parent", "place"), "bfs")
        if level.isEmpty():
            break
        levels.append(level)
        if len(levels) > 8:  # deep searches keep few tables: the work of a level doesn't grow with its number
            old = levels[0]
            for x in levels[1:]:
                old = old.unionByName(x)
            merged = materialise(old, "bfs")
            discard(*levels[:-1])
            levels = [merged.where(F.col("depth") < d), merged.where(F.col("depth") == d)]
            level = levels[-1]
        if goal is not None and not level.where(F.col("node") == goal).isEmpty():
            break
        if limit is not None and found_enough(levels, limit):
            break
    found = levels[0]
    for x in levels[1:]:
        found = found.unionByName(x)
    if limit is not None:
        w = Window.partitionBy("origin").orderBy("depth", "place")
        return found.where("depth = 0").unionByName(found.where("depth > 0").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n"))
    return found


def seeds_of(edges: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """Seeds that are their own origins."""
    return edges.sparkSession.createDataFrame([(n, n) for n in nodes], "origin string, node string")


def dependencies(edges: DataFrame, start: str, depth: int = NO_LIMIT, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """(file, depth) reached over file edges, without the start."""
    inner = edges.where("to_type = 'file'")
    found = bfs(inner, seeds_of(edges, [start]), depth, "in" if reverse else "out", limit)
    return found.where("depth > 0").select(F.col("node").alias("file"), "depth")


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(position, file) along the first-discovered shortest path; no rows if there is none.

    The search stops at the level of the goal; the path is then followed back
    over the parents, one lookup a step.
    """
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([(0, start)], "position int, file string")
    found = materialise(bfs(edges.where("to_type = 'file'"), seeds_of(edges, [start]), goal=end).select("node", "depth", "parent"), "path-search")
    path, node = [], end
    while (row := found.where(F.col("node") == node).first()) is not None:
        path.append((row["depth"], node))
        if not row["depth"]:
            break
        node = row["parent"]
    return spark.createDataFrame(path[::-1], "position int, file string")


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _chains(links: DataFrame) -> DataFrame | None:
    """(v, head, tail, ring), or None if there are none, of the nodes of ``links`` (u, v; distinct, no loops) with one way in and one way out.

    ``head`` and ``tail`` are the ends of the maximal chain that v lies in, found
    by pointers that double their reach in every round; ``ring`` is the greatest
    node of a cycle made of such nodes only, which has no ends.
    """
    out = links.groupBy("u").agg(F.count("*").alias("n_out"), F.min("v").alias("tail"))
    into = links.groupBy("v").agg(F.count("*").alias("n_in"), F.min("u").alias("head"))
    state = out.join(into, out["u"] == into["v"]).where("n_out = 1 and n_in = 1").select("v", "head", "tail", F.col("v").alias("top"), F.lit(True).alias("open"))
    state = materialise(state, "chains")
    n = state.count()
    if not n:
        return None
    for _ in range(n.bit_length() + 1):
        fore = state.select(F.col("v").alias("tail"), F.col("tail").alias("t2"), F.col("top").alias("top2"))
        back = state.select(F.col("v").alias("head"), F.col("head").alias("h2"))
        both = state.join(fore, "tail", "left").join(back, "head", "left")
        new = materialise(both.select("v", F.coalesce("h2", "head").alias("head"), F.coalesce("t2", "tail").alias("tail"), F.greatest("top", F.coalesce("top2", "top")).alias("top"), F.col("t2").isNotNull().alias("open")), "chains")
        discard(state)
        state, going = new, new.where("open").limit(1).count()
        if not going:
            break
    # a pointer that still stands on a chain node after all rounds goes round a ring
    ends = state.select(F.col("v").alias("tail"), F.lit(True).alias("inner"))
    return state.join(ends, "tail", "left").select("v", "head", "tail", F.when(F.col("inner"), F.col("top")).alias("ring"))


def thinned(links: DataFrame, local: int = LOCAL) -> tuple[DataFrame, int]:
    """A table of links by which the same nodes of ``links`` (u, v) reach each other, and its number of rows; links of a node to itself stay.

    Every task thins what it reads, ``local`` links at a time, before anything
    moves: of a graph with many more edges than nodes little more than a ring
    for each component is left. Goes on while more than ``local`` links are left
    and a round takes off a quarter.
    """
    thin = lambda t: t.mapInArrow(lambda batches: reach.thinned(batches, local), t.schema).distinct()
    table = materialise(thin(links.where("u is not null and v is not null")), "scc")
    n, before = table.count(), None
    while n > local and (before is None or 4 * n < 3 * before):
        old, before = table, n
        table = materialise(thin(old.coalesce(-(-n // max(1, local)))), "scc")
        discard(old)
        n = table.count()
    return table, n


def strong_components(edges: DataFrame, src: str = "from_path", dst: str = "to_path", max_rounds: int = 10_000, local: int = LOCAL) -> DataFrame:
    """(node, component): strongly connected components of two or more nodes, named by their greatest node.

    Links are thinned first. One task searches up to ``local`` of what is left;
    more go through the rounds of :func:`_rounds`.
    """
    return _components(*thinned(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u != v"), local), max_rounds, local)


def _components(links: DataFrame, n: int, max_rounds: int = 10_000, local: int = LOCAL) -> DataFrame:
    """:func:`strong_components` of ``n`` distinct ``links`` (u, v) without loops."""
    if n > local:
        return _rounds(links, max_rounds)
    schema = links.select(F.col("u").alias("node"), F.col("v").alias("component")).schema
    return links.coalesce(1).mapInArrow(reach.labelled, schema)


def _rounds(every: DataFrame, max_rounds: int) -> DataFrame:
    """Components of links (u, v; distinct, no loops) of any number.

    Chains are drawn together first, in rounds that grow with the logarithm of
    their length. Of what is left, nodes without a way in or out are trimmed, and
    the rest is coloured: nodes take the greatest label that reaches them, two
    hops a round; the nodes of a colour from which its root can be reached are a
    component. What is left goes into the next round.
    """
    chains, left = _chains(every), every
    if chains is not None:
        chains = materialise(chains, "scc-chains")
        inner = chains.select(F.col("v").alias("x"))
        apart = every.join(inner, F.col("u") == F.col("x"), "left_anti").join(inner, F.col("v") == F.col("x"), "left_anti")
        drawn = chains.where("ring is null").select(F.col("head").alias("u"), F.col("tail").alias("v")).where("u != v")
        left = materialise(apart.unionByName(drawn).distinct(), "scc")
    done: list[DataFrame] = []
    for _ in range(max_rounds):
        size = left.count()
        while size:  # trim
            thin = left.join(left.select(F.col("v").alias("x")).distinct(), F.col("u") == F.col("x"), "left_semi").join(left.select(F.col("u").alias("y")).distinct(), F.col("v") == F.col("y"), "left_semi")
            before, left = left, materialise(thin, "scc")
            discard(before if before is not every else None)
            now = left.count()
            if now == size:
                break
            size = now
        if not size:
            break
        colour = materialise(left.select(F.col("u").alias("n")).distinct().select("n", F.col("n").alias("c"), F.lit(True).alias("moved")), "scc-colour")
        while True:
            new = colour.select("n", "c")
            for _ in range(2):
                sent = left.join(new, left["u"] == new["n"]).groupBy("v").agg(F.max("c").alias("m"))
                new = new.join(sent, new["n"] == sent["v"], "left").select("n", F.greatest("c", F.coalesce("m", "c")).alias("c"))
            new = new.join(colour.select(F.col("n").alias("_n"), F.col("c").alias("_c")), F.col("n") == F.col("_n")).select("n", "c", (F.col("c") != F.col("_c")).alias("moved"))
            before, colour = colour, materialise(new, "scc-colour")
            discard(before)
            if colour.where("moved").isEmpty():
                break
        own = left.join(colour.select(F.col("n").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("n").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv").select(F.col("v").alias("from_path"), F.col("u").alias("to_path"))
        found = materialise(bfs(materialise(own, "scc-own"), colour.where("n = c").select(F.col("c").alias("origin"), F.col("n").alias("node"))).select("node", F.col("origin").alias("component")), "scc-found")
        done.append(found)
        gone = found.select("node")
        before, left = left, materialise(left.join(gone, left["u"] == gone["node"], "left_anti").join(gone, left["v"] == gone["node"], "left_anti"), "scc")
        discard(before if before is not every else None)
    nodes = _union(done) if done else every.select(F.col("v").alias("node"), F.col("v").alias("component")).limit(0)
    if chains is None:
        return _named(nodes)
    nodes = materialise(nodes, "scc-nodes")
    at = lambda end: nodes.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    # a chain belongs to its ends' component, or makes one with its only end
    inside = chains.where("ring is null").join(at("head"), "head", "left").join(at("tail"), "tail", "left")
    looped = inside.where("head = tail").select("v", F.coalesce("c_head", "head").alias("component"), "head")
    inside = inside.where("head != tail and c_head = c_tail").select(F.col("v").alias("node"), F.col("c_head").alias("component"))
    rings = chains.where("ring is not null").select(F.col("v").alias("node"), F.col("ring").alias("component"))
    members = _union([nodes, inside, looped.select(F.col("v").alias("node"), "component"), looped.select(F.col("head").alias("node"), "component"), rings]).distinct()
    return _named(materialise(members, "scc-members"))


def _named(members: DataFrame) -> DataFrame:
    """``members`` (node, component) of components of two or more nodes, named by the greatest."""
    big = members.groupBy("component").agg(F.count("*").alias("n"), F.max("node").alias("name")).where("n > 1")
    return members.join(big, "component").select("node", F.col("name").alias("component"))


DOCUMENTS = r"(?i)\.(md|mdx|rst|adoc|txt|html?)$"


def cycle_labels(edges: DataFrame) -> DataFrame:
    """(node, component) of every file on a cycle of files, self-loops included; cycles of documents only are left out."""
    links, n = thinned(edges.where("to_type = 'file'").select(F.col("from_path").alias("u"), F.col("to_path").alias("v")))
    labels = materialise(_components(links.where("u != v"), n), "cycles")
    loops = links.where("u = v").select(F.col("u").alias("node")).distinct().join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    labels = materialise(labels.unionByName(loops), "cycles")
    code = labels.where(~F.col("node").rlike(DOCUMENTS)).select("component").distinct()
    return labels.join(code, "component", "left_semi").select("node", "component")


def cycles(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(files, size, internal_edges, entry_edges, fan_in, priority, component) of every cycle of files; ``component`` names it by its greatest file."""
    inner = edges.where("to_type = 'file'").select("from_path", "to_path")
    labels = materialise(cycle_labels(edges), "cycles") if labels is None else labels
    at = by_nodes(labels)
    a, b = at.select(F.col("node").alias("from_path"), F.col("component").alias("ca")), at.select(F.col("node").alias("to_path"), F.col("component").alias("cb"))
    met = inner.join(b, "to_path").join(a, "from_path", "left").withColumn("inside", F.col("ca").eqNullSafe(F.col("cb")))
    # one row for the edges within a cycle and one for each importer from outside, counted before they move
    seen = met.groupBy(F.col("cb").alias("component"), "inside", F.when(~F.col("inside"), F.col("from_path")).alias("importer")).agg(F.count("*").alias("n"))
    counts = seen.groupBy("component").agg(
        F.coalesce(F.sum(F.when(F.col("inside"), F.col("n"))), F.lit(0)).alias("internal_edges"),
        F.coalesce(F.sum(F.when(~F.col("inside"), F.col("n"))), F.lit(0)).alias("entry_edges"),
        F.count("importer").alias("fan_in"),
    )
    sets = labels.groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_list("node")), ",").alias("files"))
    return sets.join(counts, "component").select("files", "size", "internal_edges", "entry_edges", "fan_in", (3 * F.col("size") + 2 * F.col("fan_in") + F.col("internal_edges")).alias("priority"), "component")


def weakest_edges(edges: DataFrame, coupling: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(component, from_path, to_path, coupling, type_only): the edge to cut in each cycle, of the least symbol ``coupling`` (from_file, to_file, edges), type-only before others, then by name."""
    edges = materialise(edges.where("to_type = 'file'").select("from_path", "to_path", "to_type", "type_only"), "weakest")
    labels = materialise(cycle_labels(edges), "cycles") if labels is None else labels
    at = by_nodes(labels)
    a, b = at.select(F.col("node").alias("from_path"), "component"), at.select(F.col("node").alias("to_path"), "component")
    inside = edges.where("to_type = 'file' and from_path != to_path").join(a, "from_path").join(b, ["to_path", "component"])
    inner = inside.groupBy("component", "from_path", "to_path").agg(F.bool_and(F.coalesce("type_only", F.lit(False))).alias("type_only"))
    rows = inner.join(coupling.select(F.col("from_file").alias("from_path"), F.col("to_file").alias("to_path"), "edges"), ["from_path", "to_path"], "left")
    n = F.coalesce("edges", F.lit(0)).cast("long")
    best = rows.groupBy("component").agg(F.min(F.struct(n.alias("coupling"), (~F.col("type_only")).cast("int").alias("t"), "from_path", "to_path", "type_only")).alias("b"))
    return best.select("component", "b.from_path", "b.to_path", "b.coupling", "b.type_only")


def hotspots(files: DataFrame, edges: DataFrame, limit: int | None = 20) -> DataFrame:
    """(file, fan_in, fan_out, score) of files; fan_out counts every edge, fan_in edges between files in scope."""
    out = edges.groupBy(F.col("from_path").alias("file")).agg(F.count("*").alias("fan_out"))
    scope = by_nodes(files.select("path"))
    inward = edges.where("to_type = 'file'").join(scope, F.col("from_path") == F.col("path"), "left_semi").groupBy(F.col("to_path").alias("file")).agg(F.count("*").alias("fan_in"))
    rows = files.select(F.col("path").alias("file")).join(out, "file", "left").join(inward, "file", "left").na.fill(0, ["fan_in", "fan_out"])
    scored = rows.select("file", "fan_in", "fan_out", (2 * F.col("fan_in") + F.col("fan_out")).alias("score")).orderBy(F.desc("score"), F.desc("fan_in"), F.desc("fan_out"), "file")
    return scored if limit is None else scored.limit(limit)


def neighbors(edges: DataFrame, start: str, depth: int = 1, direction: str = "both", labels: Sequence[str] | None = None) -> DataFrame:
    """(from_id, to_id, label): symbol edges touched within ``depth``; a label filter leaves unlabelled edges out."""
    use = edges.where(F.col("label").isin(*labels)) if labels else edges
    seen = bfs(use, seeds_of(edges, [start]), depth, direction, src="from_id", dst="to_id").where(F.col("depth") < depth).select("node")
    out = use.join(seen, use["from_id"] == seen["node"], "left_semi") if direction in ("out", "both") else None
    back = use.join(seen, use["to_id"] == seen["node"], "left_semi") if direction in ("in", "both") else None
    rows = out.unionByName(back) if out is not None and back is not None else out if out is not None else back
    return rows.select("from_id", "to_id", "label").distinct()


def call_hierarchy(edges: DataFrame, symbols: DataFrame, target: str, depth: int = 1, callers: bool = True, limit: int = 100) -> DataFrame:
    """(id, name, file, depth, sites) of callers or callees over ``calls`` edges, by depth, file, name, id."""
    calls = materialise(edges.where("label = 'calls'").select("from_id", "to_id", "seq"), "calls")
    depth = min(max(depth, 1), 15)
    near, far = ("from_id", "to_id") if callers else ("to_id", "from_id")
    reach = materialise(bfs(calls, seeds_of(edges, [target]), depth, "in" if callers else "out", src="from_id", dst="to_id").select("node", "depth"), "hierarchy")
    sites = calls.join(reach.where(F.col("depth") < depth).select(F.col("node").alias(far)), far, "left_semi").groupBy(F.col(near).alias("node")).agg(F.countDistinct("seq").alias("sites"))
    rows = reach.where("depth > 0").join(sites, "node", "left").join(symbols, F.col("node") == F.col("id"))
    return rows.select("id", "name", "file", "depth", F.coalesce("sites", F.lit(0)).alias("sites")).orderBy("depth", "file", "name", "id").limit(limit)


def n_hop(edges: DataFrame, starts: Sequence[str], hops: int = 2) -> DataFrame:
    """(from_path, to_path, type_only, edges): the undirected neighbourhood; type-only if all parallel edges are."""
    inner = edges.where("to_type = 'file'")
    seeds = edges.sparkSession.createDataFrame([("*", s) for s in starts], "origin string, node string")
    near = materialise(bfs(inner, seeds, hops, "both").select("node").distinct(), "hops")
    a, b = near.select(F.col("node").alias("from_path")), near.select(F.col("node").alias("to_path"))
    rows = inner.join(a, "from_path", "left_semi").join(b, "to_path", "left_semi")
    return rows.groupBy("from_path", "to_path").agg(F.bool_and("type_only").alias("type_only"), F.count("*").alias("edges"))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (from, to, type): precise before heuristic before none, then confidence, then first seen."""
    rank = F.when(F.col("resolved") == "precise", 2).when(F.col("resolved") == "heuristic", 1).otherwise(0)
    best = F.struct((-rank).alias("r"), (-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "seq", "raw", "type_only", "resolved", "confidence")
    # a partial minimum, so a popular edge doesn't meet in one task as a window's partition would
    return edges.groupBy("from_path", "to_path", "to_type").agg(F.min(best).alias("b")).select("from_path", "to_path", "to_type", "b.raw", "b.type_only", "b.resolved", "b.confidence", "b.seq")


def unresolved_imports(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(name, importers, n_importers) of external targets by number of importing files."""
    rows = edges.where("to_type = 'external'").select(F.col("to_path").alias("name"), "from_path").distinct()
    out = rows.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("from_path")), ",").alias("importers"), F.count("*").alias("n_importers")).orderBy(F.desc("n_importers"), "name")
    return out if limit is None else out.limit(limit)


def triples(edges: DataFrame, symbols: DataFrame, symbol_edges: DataFrame) -> DataFrame:
    """(subject, predicate, object): file edges as ``imports``, symbol edges by label or as ``uses``; unknown ends go."""
    first = edges.select(F.col("from_path").alias("subject"), F.lit("imports").alias("predicate"), F.col("to_path").alias("object"))
    known = symbols.select("id")
    kept = symbol_edges.join(known, F.col("from_id") == F.col("id"), "left_semi").join(known, F.col("to_id") == F.col("id"), "left_semi")
    second = kept.select(F.col("from_id").alias("subject"), F.coalesce("label", F.lit("uses")).alias("predicate"), F.col("to_id").alias("object"))
    return first.unionByName(second)


_CYCLE_ORDER = {"priority": ["priority", "size", "fan_in"], "size": ["size", "priority", "fan_in"], "fanin": ["fan_in", "priority", "size"]}


def cycles_sorted(edges: DataFrame, mode: str = "priority", limit: int | None = None) -> DataFrame:
    """:func:`cycles` in descending order of ``mode`` (priority, size or fanin), then by files."""
    found = cycles(edges).orderBy(*[F.desc(c) for c in _CYCLE_ORDER[mode]], "files")
    return found if limit is None else found.limit(limit)


def implementations(edges: DataFrame, symbols: DataFrame, target: str, depth: int = 10) -> DataFrame:
    """(id, name, file, depth, status) of the types that implement ``target``, directly or through subtypes; ends without a symbol are unresolved."""
    types = edges.where("label in ('extends', 'implements')")
    found = bfs(types, seeds_of(edges, [target]), depth, "in", src="from_id", dst="to_id").where("depth > 0").select("node", "depth")
    rows = found.join(symbols, F.col("node") == F.col("id"), "left")
    return rows.select(F.col("node").alias("id"), "name", "file", "depth", F.when(F.col("name").isNull(), "unresolved").otherwise("resolved").alias("status"))
