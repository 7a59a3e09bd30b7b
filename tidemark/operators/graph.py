"""Graph operators on an edge table (edge_id, src, dst): iterative joins.

Each round writes its frontier to the shared scratch folder, so lineage stays
flat and a lost executor repeats one round only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def _frame(edges: DataFrame, node: str, **cols: Column) -> DataFrame:
    """One-row frame for a start node, typed like the edge ends."""
    kind = edges.schema["src"].dataType
    return edges.sparkSession.range(1).select(F.lit(node).cast(kind).alias("node"), *[c.alias(n) for n, c in cols.items()])


def distance_to(edges: DataFrame, end: str, max_depth: int) -> DataFrame:
    """Nodes that reach ``end`` within ``max_depth`` edges, with the distance.  ``edges`` are read once a round: store them first."""
    seen = frontier = _frame(edges, end, dist=F.lit(0))
    for d in range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        frontier = materialize(step.join(seen.select("node"), "node", "left_anti").withColumn("dist", F.lit(d)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def find_paths(edges: DataFrame, start: str, end: str, max_depth: int = 5, limit: int = 100) -> DataFrame:
    """Directed paths of 1..max_depth distinct edges, shortest first.

    Backward distances prune every partial path that cannot arrive in time, and
    the search stops at the first depth that fills ``limit``.
    """
    edges = materialize(edges.select("edge_id", "src", "dst"), "edges")
    near = distance_to(edges, end, max_depth - 1).select(F.col("node").alias("dst"), "dist")
    steps = materialize(edges.join(near, "dst"), "steps")
    paths = _frame(edges, start, nodes=F.array(F.lit(start).cast(edges.schema["src"].dataType)),
                   used=F.array().cast(f"array<{edges.schema['edge_id'].dataType.simpleString()}>"))
    found, total = [], 0
    for depth in range(1, max_depth + 1):
        grown = (
            paths.join(steps.where(F.col("dist") <= max_depth - depth), F.col("node") == F.col("src"))
            .where(~F.array_contains("used", F.col("edge_id")))
            .select(F.col("dst").alias("node"), F.array_append("nodes", F.col("dst")).alias("nodes"),
                    F.array_append("used", F.col("edge_id")).alias("used"))
        )
        paths = materialize(grown, "paths")
        done = paths.where(F.col("node") == end)
        found.append(done.select(F.lit(depth).alias("length"), "nodes", "used"))
        total += done.limit(limit).count()
        if total >= limit or paths.isEmpty():
            break
    text = F.array_join("nodes", ">")
    every = reduce(DataFrame.unionByName, found).select("length", text.alias("path"), F.array_join("used", ">").alias("edges"))
    return every.orderBy("length", "path", "edges").limit(limit)


def neighbors(edges: DataFrame, start: str, depth: int = 1, limit: int = 1000) -> DataFrame:
    """Distinct nodes within ``depth`` undirected hops of ``start``, lowest ids first."""
    ends = edges.select("src", "dst")
    both = materialize(ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "edges")
    seen = frontier = _frame(edges, start)
    for _ in range(depth):
        step = both.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen, "node", "left_anti"), "hop")
        seen = seen.union(frontier)
    return seen.where(F.col("node") != start).orderBy("node").limit(limit)


def statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n = vertices.select("id").distinct().agg(F.count(F.lit(1)).alias("nodes")).withColumn("relationships", F.lit(0).cast("long"))
    m = edges.agg(F.count(F.lit(1)).alias("relationships")).withColumn("nodes", F.lit(0).cast("long"))
    return n.unionByName(m).agg(F.sum("nodes").alias("nodes"), F.sum("relationships").alias("relationships"))


def relate(sources: DataFrame, targets: DataFrame, source_prop: str, target_prop: str, kind: str) -> DataFrame:
    """New edges between vertices whose properties match."""
    s = sources.select(F.col("id").alias("src"), F.col(source_prop).alias("_p"))
    d = targets.select(F.col("id").alias("dst"), F.col(target_prop).alias("_p"))
    return s.join(d, "_p").select("src", "dst", F.lit(kind).alias("type"))


def detach_delete(vertices: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining vertices and edges after deleting ``doomed`` ids with their edges."""
    ids = doomed.select("id").distinct()
    kept = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti")
    kept = kept.join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return vertices.join(ids, "id", "left_anti"), kept


def _stored(df: DataFrame, label: str) -> DataFrame:
    """A table of a round whose joins shuffle.  Rounds are many and their tables as
    large as the graph or nearly so: broadcasts of all of them would pass the driver."""
    return materialize(df, label).hint("merge")


def _pointers(edges: DataFrame, *extra: Column) -> DataFrame:
    """(node, to, ...) of the nodes with one outgoing edge."""
    one = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.max("dst").alias("to"), *extra)
    return one.where("_n = 1").drop("_n")


def _doubled(pointers: DataFrame, joined: Callable[[DataFrame, DataFrame], DataFrame], count: int) -> tuple[list[DataFrame], DataFrame]:
    """Pointers (node, to, ...) after 1, 2, 4, ... steps, until none ends at a node with a
    pointer, and those that still do after ``count`` steps, so lead into a ring.

    ``joined`` follows each pointer by the one of its end (columns named ``_2`` there)."""
    tables = [pointers]
    while True:
        p = tables[-1]
        open_ = p.join(p.select(F.col("node").alias("to")), "to", "left_semi")
        if 2 ** (len(tables) - 1) >= count or open_.isEmpty():
            return tables, open_
        second = p.select(*[F.col(c).alias(f"{c}_2") for c in p.columns])
        tables.append(_stored(joined(p, second), "doubled"))


def dependency_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest-path level of every node (``src`` depends on ``dst``); level 0 has no
    dependency.  A cycle is an error; edges with a null end and loops do not count.

    A node knows a least level so far, and every edge a length.  Each round takes off
    the nodes without dependencies, whose level is final, and sets the nodes with a
    single dependency aside: their pointers are doubled until they end at another
    kind of node, and edges to them are led there.  So chains and trees of any depth
    take rounds in the logarithm of their depth.  Nodes set aside get their levels
    from the ends of their pointers afterwards, last round first.

    Repeated edges do no harm: a node has one dependency if the least and the greatest
    are equal.  They go when edges are first led on, so they are not sought before."""
    live = materialize(edges.select("src", "dst", F.lit(1).cast("long").alias("w")).where("src <> dst"), "live")
    acc = nodes.select(F.col("id").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct().withColumn("acc", F.lit(0).cast("long"))
    final, aside = [], []

    def follow(p: DataFrame, q: DataFrame) -> DataFrame:
        met = p.join(q, p["to"] == q["node_2"], "left")
        least = F.greatest("acc", F.col("w") + F.coalesce("acc_2", F.lit(0)))
        return met.select("node", F.coalesce("to_2", "to").alias("to"), (F.col("w") + F.coalesce("w_2", F.lit(0))).alias("w"), least.alias("acc"))

    while True:
        out = live.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("lo"), F.max("dst").alias("to"), F.max("w").alias("w"))
        # in the first round nodes that only depend on others come from the edges
        now = acc.join(out, "node", "left" if final else "full_outer").withColumn("acc", F.coalesce("acc", F.lit(0).cast("long")))
        now = materialize(now, "degrees")
        if now.isEmpty():
            break
        done = now.where("to is null").select("node", F.col("acc").alias("level"))
        ones = now.where("lo = to").select("node", "to", "w", "acc")
        core, single = now.where("lo <> to").select("node", "acc"), ones.count()
        if not single and done.isEmpty():
            raise ValueError("cycle in the dependency graph")
        tables, ring = _doubled(ones, follow, single)
        if single and not ring.isEmpty():
            raise ValueError("cycle in the dependency graph")
        far = tables[-1]
        final.append(done)
        aside.append(far)
        led = live.join(core.select(F.col("node").alias("src")), "src", "left_semi")
        led = led.join(far.select(F.col("node").alias("dst"), "to", F.col("w").alias("_w"), F.col("acc").alias("_acc")), "dst", "left")
        led = led.select("src", F.coalesce("to", "dst").alias("dst"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), (F.col("w") + F.col("_acc")).alias("least"))
        # edges with the same ends now need to be there once
        led = led.groupBy("src", "dst").agg(F.max("w").alias("w"), F.max("least").alias("least"))
        led = led.join(done.select(F.col("node").alias("dst"), "level"), "dst", "left")
        led = materialize(led.select("src", "dst", "w", "least", (F.col("level") + F.col("w")).alias("reached")), "led")
        if not led.where("src = dst").isEmpty():
            raise ValueError("cycle in the dependency graph")
        least = led.groupBy(F.col("src").alias("node")).agg(F.max(F.greatest("least", "reached")).alias("_least"))
        acc = materialize(core.join(least, "node", "left").select("node", F.greatest("acc", "_least").alias("acc")), "levels")
        live = led.where("reached is null").select("src", "dst", "w")
    if not final:
        return now.select("node", F.col("acc").cast("int").alias("level"))
    known = reduce(DataFrame.unionByName, final)
    for far in reversed(aside):
        ends = known.select(F.col("node").alias("to"), "level")
        known = materialize(known.unionByName(far.join(ends, "to").select("node", F.greatest("acc", F.col("level") + F.col("w")).alias("level"))), "known")
    return known.select("node", F.col("level").cast("int").alias("level"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose end goes on and whose start is reached: no others are on cycles."""
    kept = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return kept.join(kept.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi").select("src", "dst")


def _spread_label(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest label that reaches each node along ``edges`` (node, label)."""
    while True:
        moved = edges.join(labels.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.col("label").alias("_m"))
        new = labels.join(moved.groupBy("node").agg(F.min("_m").alias("_m")).hint("merge"), "node", "left")
        new = _stored(new.select("node", F.least("label", F.coalesce("_m", "label")).alias("label"), (F.col("_m") < F.col("label")).alias("changed")), "labels")
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            return labels


def _flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


class _Contraction:
    """Takes the nodes with one outgoing edge out of a graph.

    What reaches such a node reaches the node its pointers end at, so edges to it are
    led there and the rest keeps its components.  Rings of such nodes are components
    themselves.  A node taken out belongs to its end's component if one of that
    component reaches it (``members``)."""

    def __init__(self, edges: DataFrame):
        first = _stored(_pointers(edges).withColumn("low", F.col("node")), "pointers")
        self.count = first.count()
        self.tables, ring = _doubled(first, self._follow, self.count)
        far = self.tables[-1]
        on_ring = ring.select(F.col("to").alias("node")).distinct()
        self.rings = _stored(far.join(on_ring, "node", "left_semi").select("node", F.col("low").alias("component")), "rings")
        ends = far.join(ring.select("node"), "node", "left_anti").select("node", "to")
        self.ends = ends = _stored(ends, "ends")
        # edges of the nodes that stay; those into a ring do not come back
        stay = edges.join(first.select(F.col("node").alias("src")), "src", "left_anti").join(ring.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti")
        led = stay.join(ends.select(F.col("node").alias("dst"), "to"), "dst", "left")
        led = _stored(led.select("src", F.col("dst").alias("by"), F.coalesce("to", "dst").alias("dst"), F.col("to").isNotNull().alias("led")), "led")
        self.entries = led.where("led").select("src", "by", "dst")
        self.loops = led.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
        self.edges = _stored(led.where("src <> dst").select("src", "dst").distinct(), "core")

    @staticmethod
    def _follow(p: DataFrame, q: DataFrame) -> DataFrame:
        met = p.join(q, p["to"] == q["node_2"], "left")
        return met.select("node", F.coalesce("to_2", "to").alias("to"), F.least("low", "low_2").alias("low"))

    def members(self, named: DataFrame) -> DataFrame:
        """(node, component) of the nodes taken out that lie on a cycle through their ends."""
        own = lambda end: named.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
        met = self.entries.join(own("src"), "src", "left").join(own("dst"), "dst", "left")
        same = F.coalesce("_src", "src") == F.coalesce("_dst", "dst")
        marked = _stored(met.where(same).select(F.col("by").alias("node")).distinct(), "marked")
        for steps in self.tables:
            ahead = steps.join(marked, "node", "left_semi").select(F.col("to").alias("node"))
            marked = _stored(marked.unionByName(ahead).distinct(), "marked")
        found = self.ends.join(marked, "node", "left_semi").join(own("to"), "to", "left")
        return found.select("node", F.coalesce("_to", "to").alias("component"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that lies on a cycle; a component is named by
    its lowest node.

    Each round trims edges that cannot be on a cycle and contracts nodes with a single
    way on, then those with a single way back, by pointer doubling, so rings and chains
    of any length take rounds in the logarithm of their length.  Where this takes off
    little, every node of the core gets the smallest node that reaches it; within such
    a colour, what reaches the colour's own node back is one component.  Nodes taken
    out are placed last."""
    pairs = _stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    loops = [pairs.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))]
    found: list[DataFrame] = [loops[0].limit(0)]
    live, taken = _stored(pairs.where("src <> dst"), "core"), []
    left = live.count()
    while left:
        live = _stored(_trimmed(live), "core")
        for turned in (False, True):
            out = _Contraction(_flipped(live) if turned else live)
            if out.count:
                taken.append(out)
                found.append(out.rings)
                loops.append(out.loops)
                live = _flipped(out.edges) if turned else out.edges
        before, left = left, live.count()
        if left and left > before * 3 / 4:
            component = _colour_round(live)
            found.append(component)
            for end in ("src", "dst"):
                live = live.join(component.select(F.col("node").alias(end)), end, "left_anti")
            live = _stored(live.select("src", "dst"), "core")
            left = live.count()
    named = _stored(reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("component").alias("component")), "named")
    for out in reversed(taken):
        more = named.unionByName(out.members(named)).groupBy("node").agg(F.min("component").alias("component"))
        named = _stored(more, "named")
    # a node that only leads back to itself, directly or by nodes taken out
    named = named.unionByName(reduce(DataFrame.unionByName, loops).distinct().join(named.select("node"), "node", "left_anti"))
    low = named.groupBy("component").agg(F.min("node").alias("low")).hint("merge")
    named = named.join(low, "component").select("node", F.col("low").alias("component"))
    tail, head = (named.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")) for end in ("src", "dst"))
    inside = pairs.join(tail, "src").join(head.hint("merge"), "dst").where("_src = _dst")
    return _stored(named.join(inside.select(F.col("src").alias("node")).distinct().hint("merge"), "node", "left_semi"), "components")


def _colour_round(live: DataFrame) -> DataFrame:
    """(node, component): one component for each colour of the core, found whole."""
    nodes = live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct()
    colour = _spread_label(nodes.withColumn("label", F.col("node")), live)
    tail, head = (colour.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")) for end in ("src", "dst"))
    same = _stored(live.join(tail, "src").join(head, "dst").where("_src = _dst").select("src", "dst", F.col("_src").alias("label")), "colours")
    reached = _stored(colour.where("node = label").select("node", "label"), "back")
    frontier = reached
    while not frontier.isEmpty():
        step = same.join(frontier.select(F.col("node").alias("dst"), "label"), ["dst", "label"]).select(F.col("src").alias("node"), "label").distinct()
        frontier = _stored(step.join(reached, ["node", "label"], "left_anti"), "back")
        reached = _stored(reached.unionByName(frontier), "back")
    return reached.select("node", F.col("label").alias("component"))


def find_cycles(edges: DataFrame) -> DataFrame:
    """A witness cycle for each group of nodes on common cycles, one row per node on it:
    component (its lowest node), nodes, edges (of the whole group), step, node.

    Every node of a group points at its lowest successor there.  The walk from the
    group's lowest node ends in a cycle, which is the witness; step 0 is its lowest
    node.  Pointers are doubled, so rounds grow with the logarithm of its length and
    no path is held in one value.  All simple cycles would be exponentially many;
    each of them lies within one group, and every group has a witness."""
    named = strongly_connected(edges)
    tail, head = (named.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")) for end in ("src", "dst"))
    inside = edges.select("src", "dst").distinct().join(tail, "src").join(head, "dst").where("_src = _dst")
    inside = _stored(inside.select("src", "dst", F.col("_src").alias("component")), "inside")
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).join(inside.groupBy("component").agg(F.count(F.lit(1)).alias("edges")), "component")
    first = _stored(inside.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("to"), F.min("component").alias("component")), "pointers")
    walk = first.select("node", "to", F.least("node", "to").alias("low"))
    tables, _ = _doubled(walk, _Contraction._follow, named.count())
    far = tables[-1]
    # the walk from a group's lowest node has arrived on its cycle, which its lowest node names
    arrived = far.join(sizes.select(F.col("component").alias("node")), "node", "left_semi").select(F.col("to").alias("node"))
    starts = _stored(far.join(arrived, "node", "left_semi").select("low").distinct(), "starts")
    ring = far.select(F.col("to").alias("node")).distinct().join(far.select("node", "low"), "node").join(starts, "low", "left_semi")
    ring = _stored(ring.join(first, "node").select("node", "to", "low", "component"), "ring")
    # steps to the lowest node, where pointers stay
    stop = F.col("node") == F.col("low")
    steps = ring.select("node", F.when(stop, F.col("node")).otherwise(F.col("to")).alias("to"), F.when(stop, 0).otherwise(1).cast("long").alias("d"))
    for _ in range(max(ring.count() - 1, 1).bit_length()):
        second = steps.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("d").alias("_d"))
        steps = _stored(steps.join(second, "to").select("node", F.col("_to").alias("to"), (F.col("d") + F.col("_d")).alias("d")), "steps")
    length = ring.groupBy("component").agg(F.count(F.lit(1)).alias("length"))
    out = ring.join(steps.select("node", "d"), "node").join(length, "component").join(sizes.hint("merge"), "component")
    return out.select("component", "nodes", "edges", ((F.col("length") - F.col("d")) % F.col("length")).alias("step"), "node")
