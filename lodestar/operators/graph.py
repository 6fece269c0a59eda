"""Call graphs as edges(src, dst): levels, reachability, paths, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import scratch


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree; nodes without edges have zero."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("in_degree"))
    return nodes.join(out, "node", "left").join(into, "node", "left").fillna(0, ["out_degree", "in_degree"])


def reached(edges: DataFrame, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """(node, depth): breadth first from starts(node), to the end or `hops` steps away. A round joins and checkpoints
    only the frontier; what was seen before is the union of the frontiers."""
    edges = edges.select("src", "dst").distinct()
    seen = front = starts.select("node", F.lit(0).alias("depth")).distinct().checkpoint()
    depth = 0
    while (hops is None or depth < hops) and not front.isEmpty():
        depth += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, starts: DataFrame, longest: int) -> DataFrame:
    """Simple paths of 1 to `longest` edges as arrays, bounded by the number of steps."""
    edges = edges.select("src", "dst").distinct()
    now = starts.select(F.array("node").alias("path"))
    out = None
    for _ in range(longest):
        now = now.join(edges, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path")).checkpoint()
        out = now if out is None else out.unionByName(now)
    return out


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that call each other."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi").where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()


def in_ranges(changes: DataFrame, ranges: DataFrame, key: str, line: str, first: str, last: str, cell: int = 64) -> DataFrame:
    """Changes joined to the ranges of the same key that hold their line: an equi-join on cells of `cell` lines."""
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(first) / cell), F.floor(F.col(last) / cell))))
    return changes.withColumn("_cell", F.floor(F.col(line) / cell)).join(cells, [key, "_cell"]).where(F.col(line).between(F.col(first), F.col(last))).drop("_cell")


def levels(edges: DataFrame, cyclic: int = 20) -> DataFrame:
    """(node, level): 0 for a node that calls nothing, else one more than its highest callee.

    A call of itself counts as a callee of level 0. Nodes on or above a longer cycle get `cyclic`. A round settles one
    level and keeps only the edges between unsettled nodes, so the work shrinks with what is left.
    """
    edges = edges.select("src", "dst").distinct()
    callers = edges.select(F.col("src").alias("node")).distinct().checkpoint()
    out = edges.select(F.col("dst").alias("node")).distinct().join(callers, "node", "left_anti").withColumn("level", F.lit(0))
    left, live = callers, edges.where("src <> dst").join(callers.withColumnRenamed("node", "dst"), "dst", "left_semi").checkpoint()
    level = 0
    while not left.isEmpty():
        level += 1
        blocked = live.select(F.col("src").alias("node")).distinct()
        settled = left.join(blocked, "node", "left_anti").checkpoint()
        if settled.isEmpty():
            break
        out = out.unionByName(settled.withColumn("level", F.lit(level)))
        left = left.join(settled, "node", "left_anti").checkpoint()
        live = live.join(settled.withColumnRenamed("node", "dst"), "dst", "left_anti").checkpoint()
    return out.unionByName(left.withColumn("level", F.lit(cyclic)))


def falling(edges: DataFrame, level: DataFrame) -> DataFrame:
    """Edges (src, dst, level of src) that lead to a lower level, which make a graph without cycles."""
    up = level.select(F.col("node").alias("src"), "level")
    down = level.select(F.col("node").alias("dst"), F.col("level").alias("_to"))
    return edges.select("src", "dst").distinct().join(up, "src").join(down, "dst").where("_to < level").select("src", "dst", "level")


def path_counts(edges: DataFrame, level: DataFrame) -> DataFrame:
    """(node, paths): paths to a node without callees in the falling graph, 1 for such a node; one join per level."""
    down = falling(edges, level).checkpoint()
    inner = down.select(F.col("src").alias("node")).distinct()
    out = level.select("node").join(inner, "node", "left_anti").withColumn("paths", F.lit(1).cast("decimal(38,0)")).checkpoint()
    for (at,) in sorted(r[:1] for r in down.select("level").distinct().collect()):  # a row per level
        step = down.where(F.col("level") == at).join(out.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"))
        out = out.unionByName(step.agg(F.sum("paths").cast("decimal(38,0)").alias("paths"))).checkpoint()
    return out


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node of the strongly connected component.

    The smallest ancestor colours every node; the nodes of a colour that reach its root are a component. Edges
    between colours, and of settled nodes, go, and the rest is coloured anew.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    live = edges.select("src", "dst").where("src <> dst").distinct().checkpoint()
    out = None
    while not live.isEmpty():
        colours = live.select(F.col("src").alias("node")).union(live.select("dst")).distinct().withColumn("colour", F.col("node")).checkpoint()
        moved = colours
        while True:  # only nodes whose colour is new offer it
            offers = live.join(moved.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
            offered = colours.join(offers, "node", "left").select("node", F.least("colour", "offer").alias("colour"), F.coalesce(F.col("offer") < F.col("colour"), F.lit(False)).alias("moved")).checkpoint()
            colours, moved = offered.drop("moved"), offered.where("moved").drop("moved")
            if moved.isEmpty():
                break
        inside = live.join(colours.withColumnRenamed("node", "src"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("_other")), "dst")
        inside = inside.where("colour = _other").select("src", "dst", "colour").checkpoint()
        found = front = colours.where("node = colour").checkpoint()
        while not front.isEmpty():
            step = front.select(F.col("node").alias("dst")).join(inside, "dst").select(F.col("src").alias("node"), "colour").distinct()
            front = step.join(found.select("node"), "node", "left_anti").checkpoint()
            found = found.unionByName(front)
        out = found if out is None else out.unionByName(found)
        live = inside.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst").checkpoint()
    if out is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(out, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))


def first_kept(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, kept): taking nodes in ascending order, one is kept unless a kept smaller one is linked to it.

    A round keeps all open nodes without an open smaller neighbour at once, drops their neighbours, and goes on with
    the links that are left; the result is that of the one-by-one order.
    """
    live = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    left = nodes.select("node").distinct().checkpoint()
    out = left.select("node", F.lit(True).alias("kept")).where("false")
    while not left.isEmpty():
        kept = left.join(live.select(F.col("b").alias("node")).distinct(), "node", "left_anti")
        gone = live.join(kept.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        done = kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False))).checkpoint()
        out = out.unionByName(done)
        left = left.join(done.select("node"), "node", "left_anti").checkpoint()
        live = live.join(done.select(F.col("node").alias("a")), "a", "left_anti").join(done.select(F.col("node").alias("b")), "b", "left_anti").checkpoint()
    return out


def component_order(edges: DataFrame) -> DataFrame:
    """(node, component, level, place): strongly connected components in topological order, callers before callees.

    The components' own graph has no cycles; a component's level is its longest way down. Places ascend from 0 by falling
    level, then by component; the nodes of a component share its place.
    """
    part = strong_components(edges).checkpoint()
    a, b = part.select(F.col("node").alias("src"), F.col("component").alias("_a")), part.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
    between = edges.select("src", "dst").join(a, "src").join(b, "dst").where("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct().checkpoint()
    single = part.select(F.col("component").alias("node")).distinct()
    level = single.join(levels(between), "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))
    placed = scratch.ranked(level, [F.desc("level"), F.asc("node")], "place").withColumnRenamed("node", "component")
    return part.join(placed, "component").select("node", "component", "level", "place")
