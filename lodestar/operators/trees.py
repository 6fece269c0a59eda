"""Call trees and paths over calls(src, dst): flows, roots, chains, depth-limited totals. Loops are bounded by depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def ends(calls: DataFrame, side: str) -> DataFrame:
    """Nodes that call nothing (side `leaf`) or that nothing calls (`root`)."""
    a, b = ("dst", "src") if side == "leaf" else ("src", "dst")
    return calls.select(F.col(a).alias("node")).distinct().join(calls.select(F.col(b).alias("node")), "node", "left_anti")


def statistics(calls: DataFrame) -> DataFrame:
    """One row: nodes, edges, leaves, roots, and mean, median, least and most callees of a node."""
    edges = calls.select("src", "dst").distinct()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    degree = graph.degrees(nodes, edges)
    return degree.agg(
        F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.count_if(F.col("out_degree") == 0).alias("leaves"), F.count_if(F.col("in_degree") == 0).alias("roots"),
        F.avg("out_degree").alias("mean"), F.median("out_degree").alias("median"), F.min("out_degree").alias("least"), F.max("out_degree").alias("most"),
    )


def cycles(calls: DataFrame, longest: int) -> DataFrame:
    """Cycles of up to `longest` edges, each once, as arrays that begin with their smallest node."""
    edges = calls.select("src", "dst").distinct()
    now = edges.where("src < dst").select(F.array("src", "dst").alias("path")).checkpoint()
    out = edges.where("src = dst").select(F.array("src").alias("path"))
    for _ in range(2, longest + 1):
        more = now.join(edges, F.element_at("path", -1) == F.col("src"))
        out = out.unionByName(more.where(F.col("dst") == F.element_at("path", 1)).select("path"))
        now = more.where((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path")).checkpoint()
    return out


def flows(calls: DataFrame, sources: DataFrame, sinks: DataFrame, hops: int = 10, per_pair: int = 3, total: int = 5000, through: str = "authentication_authorization") -> DataFrame:
    """Simple paths from sources(node) to sinks(node, category): source, sink, category, path, length.

    A path ends at its first sink, but goes on past sinks of the category `through`, which are no results. Of each
    pair the `per_pair` first by (length, path) are kept, and `total` in all, by source. Only nodes from which a sink
    can be reached are entered.
    """
    edges = calls.select("src", "dst").distinct()
    back = graph.reached(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), sinks.select("node"), hops)
    edges = edges.join(back.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").checkpoint()
    kinds = sinks.select(F.col("node").alias("at"), "category")
    now = sources.select(F.array("node").alias("path"), F.col("node").alias("at")).distinct()
    out = None
    for _ in range(hops):
        now = now.join(edges, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"))
        seen = now.join(kinds, "at", "left").checkpoint()
        done = seen.where((F.col("category").isNotNull()) & (F.col("category") != through))
        # a pair's shorter paths come first, so what exceeds its share within a step never counts
        first = done.withColumn("_k", F.row_number().over(Window.partitionBy(F.element_at("path", 1), "at").orderBy("path"))).where(F.col("_k") <= per_pair).drop("_k")
        out = first if out is None else out.unionByName(first)
        now = seen.where(F.col("category").isNull() | (F.col("category") == through)).select("path", "at")
        if now.isEmpty():
            break
    got = out.select(F.element_at("path", 1).alias("source"), F.col("at").alias("sink"), "category", "path", (F.size("path") - 1).alias("length"))
    pair = Window.partitionBy("source", "sink").orderBy("length", "path")
    return got.withColumn("_k", F.row_number().over(pair)).where(F.col("_k") <= per_pair).drop("_k").orderBy("source", "length", "path").limit(total)


def root_paths(calls: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Paths from roots(node) down to a node without a callee that is not on the path, or `depth` edges."""
    edges = calls.select("src", "dst").distinct()
    now = roots.select(F.array("node").alias("path")).distinct()
    out = None
    for _ in range(depth):
        on = now.join(edges, F.element_at("path", -1) == F.col("src"), "left").withColumn("free", F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst"))).checkpoint()
        more = on.where("free").select(F.array_append("path", F.col("dst")).alias("path"))
        ended = on.groupBy("path").agg(F.bool_or("free").alias("f")).where("NOT f").select("path")
        out = ended if out is None else out.unionByName(ended)
        now = more
    return now if out is None else out.unionByName(now)


def steps(path: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(path) - 2), lambda i: F.struct(F.get(path, i).alias("src"), F.get(path, i + 1).alias("dst")))


def longest_only(paths: DataFrame) -> DataFrame:
    """paths(path) without repeats and without those whose edges all belong to one longer path, or to an equally long one
    that comes first. Only paths that share an edge meet: the rarest edge of a path must be in what holds it."""
    p = paths.where(F.size("path") > 1).distinct().withColumn("e", steps(F.col("path")))
    each = p.select("path", F.explode("e").alias("s"))
    rare = each.join(each.groupBy("s").agg(F.count("*").alias("n")), "s").groupBy("path").agg(F.min(F.struct("n", "s")).alias("r")).select("path", "r.s")
    held = rare.join(each.select(F.col("path").alias("other"), "s"), "s").where((F.size("other") > F.size("path")) | ((F.size("other") == F.size("path")) & (F.col("other") < F.col("path"))))
    held = held.where(F.size(F.array_except(steps(F.col("path")), steps(F.col("other")))) == 0).select("path").distinct()
    return p.select("path").join(held, "path", "left_anti")


def novel_edges(paths: DataFrame, analysed: DataFrame) -> DataFrame:
    """paths(path) with how many of their edges are not in analysed(src, dst)."""
    each = paths.select("path", F.explode(steps(F.col("path"))).alias("s")).select("path", "s.src", "s.dst")
    left = each.join(analysed.select("src", "dst").distinct(), ["src", "dst"], "left_anti").groupBy("path").agg(F.count("*").alias("novel"))
    return paths.join(left, "path", "left").fillna(0, ["novel"])


def path_hash(path: Column) -> Column:
    return F.left(F.sha2(F.array_join(F.transform(path, lambda x: x.cast("string")), "|"), 256), F.lit(16))


def local_roots(calls: DataFrame, wanted: DataFrame, drop_orphans: bool = True) -> DataFrame:
    """Of wanted(node), those that none of them calls; with drop_orphans, not those without any callee."""
    inner = calls.join(wanted.select(F.col("node").alias("src")), "src", "left_semi").where("src <> dst").select(F.col("dst").alias("node"))
    out = wanted.select("node").distinct().join(inner, "node", "left_anti")
    return out.join(calls.select(F.col("src").alias("node")), "node", "left_semi") if drop_orphans else out


def nearest(calls: DataFrame, most: int, up: bool = False) -> DataFrame:
    """The first `most` callees of each node by name, or callers with up=True, as (src, dst) in walking direction."""
    e = calls.select("src", "dst").distinct()
    e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if up else e
    return e.withColumn("_k", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_k") <= most).drop("_k")


def chains(calls: DataFrame, starts: DataFrame, depth: int = 6, each: int = 5) -> DataFrame:
    """Of each of starts(node), up to `each` chains of callers, from the outermost down to it; at most `each` callers of a
    node are followed, by name, and `depth` steps. Chains are in the order in which a walk by name meets them."""
    e = nearest(calls, each, up=True)
    every = root_paths(e, starts, depth).where(F.size("path") > 1)
    order = Window.partitionBy(F.element_at("path", 1)).orderBy("path")
    return every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select(F.element_at("path", 1).alias("node"), "place", F.reverse("path").alias("chain"))


def descendants(calls: DataFrame, starts: DataFrame, depth: int = 6, each: int = 5) -> DataFrame:
    """(root, path) of every node of the trees below starts(node): of each node the first `each` callees by name that are not
    on the path to it."""
    e = calls.select("src", "dst").distinct()
    now = starts.select(F.array("node").alias("path")).distinct()
    out = now
    for _ in range(depth):
        free = now.join(e, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        few = free.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy("dst"))).where(F.col("_k") <= each)
        now = few.select(F.array_append("path", F.col("dst")).alias("path")).checkpoint()
        out = out.unionByName(now)
    return out.select(F.element_at("path", 1).alias("root"), "path")


def limited_totals(calls: DataFrame, own: DataFrame, depth: int) -> DataFrame:
    """(node, lines): lines of own(node, lines) and of all paths down to `depth` steps, each path counted."""
    e = calls.select("src", "dst").distinct()
    total = own.select("node", F.col("lines").cast("long").alias("lines"))
    for _ in range(depth):
        below = e.join(total.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("lines").alias("_b"))
        total = own.join(below, "node", "left").select("node", (F.col("lines") + F.coalesce("_b", F.lit(0))).cast("long").alias("lines")).checkpoint()
    return total


def signature(nodes: DataFrame, root: str, name: str, checksum: str) -> DataFrame:
    """The md5 of the sorted functions and checksums of each tree."""
    one = F.concat(F.col(name).cast("string"), F.lit(":"), F.col(checksum))
    return nodes.groupBy(root).agg(F.md5(F.array_join(F.array_sort(F.collect_set(one)), "|")).alias("signature"))


def children(calls: DataFrame, depth: DataFrame) -> DataFrame:
    """(src, dst, place): callees, the deepest of depth(node, level) first, then by name."""
    both = calls.select("src", "dst").distinct().join(depth.select(F.col("node").alias("dst"), "level"), "dst")
    return both.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("level"), "dst")))


def budgeted(calls: DataFrame, size: DataFrame, roots: DataFrame, depth: int = 7, chars: int = 1_500_000, nodes: int = 300) -> DataFrame:
    """(root, node, parent, depth, stub) of the tree below each of roots(node), breadth first, a node under its first parent.

    A node whose size(node, chars) would exceed what is left stays as a stub and is not expanded; later, smaller ones
    may still fit; at most `nodes` nodes, stubs included. The budget is a fold over one level of one root at a time.
    """
    edges = calls.select("src", "dst").distinct()
    state = roots.select(F.col("node").alias("root")).distinct().join(size.select(F.col("node").alias("root"), "chars"), "root").select("root", F.lit(1).cast("long").alias("n"), F.col("chars").cast("long").alias("used")).checkpoint()
    out = state.select("root", F.col("root").alias("node"), F.lit(None).cast(roots.schema["node"].dataType).alias("parent"), F.lit(0).alias("depth"), F.lit(False).alias("stub"), F.lit(0).cast("long").alias("place")).checkpoint()
    front = out
    for d in range(1, depth + 1):
        found = front.where("NOT stub").select("root", "place", F.col("node").alias("src")).join(edges, "src").groupBy("root", F.col("dst").alias("node")).agg(F.min(F.struct("place", F.col("src").alias("parent"))).alias("p"))
        found = found.join(out.select("root", "node"), ["root", "node"], "left_anti").join(size.select("node", F.col("chars").cast("long").alias("c")), "node")
        listed = found.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("p.place", "node", "p.parent", "c"))).alias("l")).join(state, "root")

        def step(s: Column, x: Column) -> Column:
            room = s["n"] < nodes
            fits = room & (s["used"] + x["c"] <= chars)
            return F.struct((s["n"] + room.cast("long")).alias("n"), (s["used"] + F.when(fits, x["c"]).otherwise(0)).alias("used"), F.when(room, F.array_append(s["took"], fits)).otherwise(s["took"]).alias("took"))

        folded = listed.withColumn("s", F.aggregate("l", F.struct("n", "used", F.array().cast("array<boolean>").alias("took")), step)).checkpoint()
        front = folded.select("root", F.posexplode(F.arrays_zip(F.slice("l", F.lit(1), F.size("s.took")).alias("x"), F.col("s.took").alias("f"))).alias("at", "z"))
        front = front.select("root", F.col("z.x.node").alias("node"), F.col("z.x.parent").alias("parent"), F.lit(d).alias("depth"), (~F.col("z.f")).alias("stub"), F.col("at").cast("long").alias("place")).checkpoint()
        out = out.unionByName(front)
        state = state.join(folded.select("root", F.col("s.n").alias("_n"), F.col("s.used").alias("_u")), "root", "left").select("root", F.coalesce("_n", "n").alias("n"), F.coalesce("_u", "used").alias("used")).checkpoint()
        if front.isEmpty():
            break
    return out.drop("place")


def flow_statistics(flows: DataFrame) -> DataFrame:
    """(what, value, n) of flows(source, sink, category, length): flows, different sources, sinks and pairs, and how many flows have
    each length and category."""
    total = flows.agg(F.count("*").alias("flows"), F.countDistinct("source").alias("sources"), F.countDistinct("sink").alias("sinks"), F.countDistinct("source", "sink").alias("pairs"))
    rows = total.unpivot([], ["flows", "sources", "sinks", "pairs"], "what", "n").select("what", F.lit("").alias("value"), "n")
    each = flows.select(F.explode(F.array(F.struct(F.lit("length").alias("what"), F.col("length").cast("string").alias("value")), F.struct(F.lit("category").alias("what"), F.col("category").alias("value")))).alias("k"))
    return rows.unionByName(each.groupBy("k.what", "k.value").agg(F.count("*").alias("n")))


def counts_by_limit(calls: DataFrame, level: DataFrame, limits: list[int]) -> DataFrame:
    """(depth, level, nodes, mean, least, median, most): how many paths down to each of the depth limits nodes have, by their level."""
    out = None
    for depth in limits:
        own = level.select("node", F.lit(1).alias("lines"))
        counts = limited_totals(calls, own, depth).join(level, "node")
        one = counts.groupBy("level").agg(F.count("*").alias("nodes"), F.avg("lines").alias("mean"), F.min("lines").alias("least"), F.median("lines").alias("median"), F.max("lines").alias("most")).withColumn("depth", F.lit(depth))
        out = one if out is None else out.unionByName(one)
    return out
