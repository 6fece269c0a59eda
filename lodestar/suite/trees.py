"""Queries on call trees and paths over the graph of nations and its part without cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, trees
from ..plans import scratch
from ..plans import stand_ins as t
from ..registry import query

DOWN = f"{t.CALLS_SQL}, e AS (SELECT src, dst FROM calls WHERE dst < src)"


def stored(spark, d):
    scratch.checkpoints(spark)
    return t.calls(spark, d).checkpoint()


def down(spark, d):
    return stored(spark, d).where("dst < src")


def shown(path="path"):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node int")


@query(f"WITH {DOWN}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, node NOT IN (SELECT src FROM e) AS leaf, node NOT IN (SELECT dst FROM e) AS root FROM n WHERE node NOT IN (SELECT src FROM e) OR node NOT IN (SELECT dst FROM e)")
def tree_leaves_and_roots(spark, d):
    e = down(spark, d)
    return trees.ends(e, "leaf").withColumn("leaf", F.lit(True)).join(trees.ends(e, "root").withColumn("root", F.lit(True)), "node", "full_outer").fillna(False, ["leaf", "root"])


@query(f"WITH {DOWN}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), g AS (SELECT node, (SELECT count(*) FROM e WHERE src = node) AS o, (SELECT count(*) FROM e WHERE dst = node) AS i FROM n) SELECT count(*) AS nodes, sum(o)::BIGINT AS edges, count(*) FILTER (WHERE o = 0) AS leaves, count(*) FILTER (WHERE i = 0) AS roots, avg(o) AS mean, median(o) AS median, min(o) AS least, max(o) AS most FROM g")
def tree_statistics(spark, d):
    return trees.statistics(down(spark, d))


@query(f"""WITH RECURSIVE {t.CALLS_SQL}, w AS (SELECT [src, dst] AS p FROM calls WHERE src < dst UNION ALL SELECT list_append(p, dst) FROM w JOIN calls ON src = p[-1] WHERE len(p) < 5 AND dst > p[1] AND NOT list_contains(p, dst))
SELECT array_to_string(p, '>') AS cycle, len(p) AS edges FROM w JOIN calls ON src = p[-1] AND dst = p[1]""")
def tree_cycles(spark, d):
    return trees.cycles(stored(spark, d), 5).select(shown().alias("cycle"), F.size("path").cast("long").alias("edges"))


@query(f"WITH RECURSIVE {t.CALLS_SQL}, r AS (SELECT 3 AS node, 0 AS depth UNION SELECT src, depth + 1 FROM r JOIN calls ON dst = node WHERE depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def tree_reverse_reach(spark, d):
    e = stored(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reached(e, nodes(spark, 3), 4)


SINKS = "k AS (SELECT * FROM (VALUES (3, 'sql'), (9, 'file'), (14, 'authentication_authorization'), (20, 'sql')) v(node, category))"
FLOWS = f"""WITH RECURSIVE {t.CALLS_SQL}, {SINKS}, w AS (SELECT [n_nationkey] AS p, NULL::VARCHAR AS category FROM nation WHERE n_nationkey IN (0, 5, 11) UNION ALL
SELECT list_append(p, dst), k.category FROM w JOIN calls ON src = p[-1] LEFT JOIN k ON k.node = dst WHERE len(p) <= 6 AND NOT list_contains(p, dst) AND (w.category IS NULL OR w.category = 'authentication_authorization')),
f AS (SELECT p[1] AS source, p[-1] AS sink, category, p AS path, len(p) - 1 AS length FROM w WHERE category IS NOT NULL AND category <> 'authentication_authorization' AND len(p) > 1),
c AS (SELECT *, row_number() OVER (PARTITION BY source, sink ORDER BY length, path) AS r FROM f)"""


def flows(spark, d):
    sinks = spark.createDataFrame([(3, "sql"), (9, "file"), (14, "authentication_authorization"), (20, "sql")], "node int, category string")
    return trees.flows(stored(spark, d), nodes(spark, 0, 5, 11), sinks, hops=6, per_pair=3)


@query(FLOWS + " SELECT source, sink, category, array_to_string(path, '>') AS path, length FROM c WHERE r <= 3")
def tree_flows(spark, d):
    return flows(spark, d).withColumn("path", shown()).withColumn("length", F.col("length").cast("long"))


@query(FLOWS + " SELECT count(*) AS flows, count(DISTINCT source) AS sources, count(DISTINCT sink) AS sinks, count(DISTINCT source * 100 + sink) AS pairs, count(*) FILTER (WHERE category = 'sql') AS sql, min(length) AS shortest, max(length) AS longest FROM c WHERE r <= 3")
def tree_flow_statistics(spark, d):
    f = flows(spark, d)
    return f.agg(F.count("*").alias("flows"), F.countDistinct("source").alias("sources"), F.countDistinct("sink").alias("sinks"), F.countDistinct("source", "sink").alias("pairs"), F.count_if(F.col("category") == "sql").alias("sql"), F.min("length").alias("shortest"), F.max("length").alias("longest"))


@query(FLOWS + " SELECT source, sink, array_to_string(path, '>') AS path FROM c WHERE r <= 3 ORDER BY length, array_to_string(path, '>') LIMIT 5")
def tree_shortest_flows(spark, d):
    return flows(spark, d).withColumn("path", shown()).orderBy("length", "path").limit(5).select("source", "sink", "path")


PATHS = f"""WITH RECURSIVE {DOWN}, root AS (SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)), w AS (SELECT [node] AS p FROM root UNION ALL SELECT list_append(p, dst) FROM w JOIN e ON src = p[-1] WHERE len(p) <= 4),
ends AS (SELECT DISTINCT p FROM w WHERE len(p) = 5 OR p[-1] NOT IN (SELECT src FROM e))"""


def root_paths(spark, d):
    e = down(spark, d)
    return trees.root_paths(e, trees.ends(e, "root"), 4).distinct()


@query(PATHS + " SELECT array_to_string(p, '>') AS path, left(sha256(array_to_string(p, '|')), 16) AS hash FROM ends WHERE len(p) - 1 >= 2 AND len(list_filter(p, lambda x: x % 5 = 0)) > 0")
def tree_root_paths(spark, d):
    """Root-to-leaf paths of two edges or more that are not made of trivial functions alone."""
    kept = root_paths(spark, d).where((F.size("path") - 1 >= 2) & F.exists("path", lambda x: x % 5 == 0))
    return kept.select(shown().alias("path"), trees.path_hash(F.col("path")).alias("hash"))


@query(f"""WITH RECURSIVE {DOWN}, w AS (SELECT [src, dst] AS p FROM e UNION ALL SELECT list_append(p, dst) FROM w JOIN e ON src = p[-1] WHERE len(p) <= 2), g AS (SELECT p, list_transform(range(1, len(p)), lambda i: p[i] * 100 + p[i + 1]) AS s FROM w)
SELECT array_to_string(p, '>') AS path FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE len(h.p) > len(g.p) AND list_has_all(h.s, g.s))""")
def tree_longest_paths(spark, d):
    """Of all paths of one to three edges, those whose edges no longer one holds."""
    e = down(spark, d)
    every = graph.paths(e, e.select(F.col("src").alias("node")).distinct(), 2)
    return trees.longest_only(every).select(shown().alias("path"))


@query(PATHS + ", n AS (SELECT p, unnest(range(1, len(p))) AS i FROM ends WHERE len(p) > 1) SELECT array_to_string(p, '>') AS path, count(*) FILTER (WHERE (p[i] + p[i + 1]) % 3 <> 0) AS novel FROM n GROUP BY p")
def tree_novel_edges(spark, d):
    paths = root_paths(spark, d).where(F.size("path") > 1)
    return trees.novel_edges(paths, down(spark, d).where("(src + dst) % 3 = 0")).withColumn("path", shown())


@query(PATHS + " SELECT array_to_string(p, '>') AS path, len(p) * 0.5::DOUBLE + 3 * len(list_filter(p, lambda x: x % 4 = 0)) + 2 * len(list_filter(p, lambda x: x % 7 = 0)) AS score FROM ends ORDER BY score DESC, path LIMIT 10")
def tree_path_priority(spark, d):
    s = F.aggregate("path", F.size("path") * 0.5, lambda a, x: a + F.when(x % 4 == 0, 3.0).otherwise(0.0) + F.when(x % 7 == 0, 2.0).otherwise(0.0))
    return root_paths(spark, d).select(shown().alias("path"), s.alias("score")).orderBy(F.desc("score"), "path").limit(10)


@query(f"WITH {t.CALLS_SQL}, w AS (SELECT n_nationkey AS node FROM nation WHERE n_nationkey % 3 = 0) SELECT node FROM w WHERE node NOT IN (SELECT dst FROM calls JOIN w ON src = w.node WHERE src <> dst) AND node IN (SELECT src FROM calls)")
def tree_local_roots(spark, d):
    return trees.local_roots(t.calls(spark, d), t.table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("node")))


UP = "u AS (SELECT dst AS src, src AS dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM (SELECT DISTINCT src, dst FROM calls)) WHERE k <= 2)"


@query(f"""WITH RECURSIVE {t.CALLS_SQL}, {UP}, w AS (SELECT [n_nationkey] AS p FROM nation WHERE n_nationkey IN (3, 9) UNION ALL SELECT list_append(p, dst) FROM w JOIN u ON src = p[-1] WHERE len(p) <= 3 AND NOT list_contains(p, dst)),
c AS (SELECT p FROM w WHERE len(p) > 1 AND (len(p) = 4 OR NOT EXISTS (SELECT 1 FROM u WHERE src = p[-1] AND NOT list_contains(p, dst)))), r AS (SELECT p, row_number() OVER (PARTITION BY p[1] ORDER BY p) AS place FROM c)
SELECT p[1] AS node, place, array_to_string(list_reverse(p), '>') AS chain FROM r WHERE place <= 2""")
def tree_ancestor_chains(spark, d):
    return trees.chains(stored(spark, d), nodes(spark, 3, 9), 3, 2).withColumn("chain", shown("chain"))


@query(f"""WITH RECURSIVE {t.CALLS_SQL}, w AS (SELECT [n_nationkey] AS p FROM nation WHERE n_nationkey IN (1, 8) UNION ALL SELECT list_append(p, (SELECT min(dst) FROM calls WHERE src = p[-1] AND NOT list_contains(p, dst))) FROM w WHERE len(p) <= 4 AND EXISTS (SELECT 1 FROM calls WHERE src = p[-1] AND NOT list_contains(p, dst)))
SELECT p[1] AS root, array_to_string(p, '>') AS path FROM w""")
def tree_descendants(spark, d):
    """The first callee of each node, four steps down."""
    return trees.descendants(stored(spark, d), nodes(spark, 1, 8), 4, 1).withColumn("path", shown())


@query(f"WITH RECURSIVE {DOWN}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), w AS (SELECT node AS start, node, 0 AS k FROM n UNION ALL SELECT start, dst, k + 1 FROM w JOIN e ON src = node WHERE k < 3) SELECT start AS node, sum(node + 10)::BIGINT AS lines FROM w GROUP BY 1")
def tree_limited_totals(spark, d):
    e = down(spark, d)
    own = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("lines", F.col("node") + 10)
    return trees.limited_totals(e, own, 3)


@query(f"WITH RECURSIVE {DOWN}, r AS (SELECT src AS root, src AS node FROM e UNION SELECT root, dst FROM r JOIN e ON src = node) SELECT root, md5(string_agg(node || ':' || md5(node::VARCHAR), '|' ORDER BY node || ':' || md5(node::VARCHAR))) AS signature FROM r GROUP BY 1")
def tree_signatures(spark, d):
    """One checksum of everything below each node, by closure of the graph without cycles."""
    e = down(spark, d)
    reach = front = e.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct()
    while not front.isEmpty():
        front = front.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct().join(reach, ["root", "node"], "left_anti").checkpoint()
        reach = reach.unionByName(front)
    return trees.signature(reach.withColumn("c", F.md5(F.col("node").cast("string"))), "root", "node", "c")


@query(f"WITH RECURSIVE {DOWN}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS (SELECT node, 0 AS level FROM n UNION SELECT src, level + 1 FROM r JOIN e ON dst = node), l AS (SELECT node, max(level) AS level FROM r GROUP BY 1) SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY level DESC, dst) AS place FROM e JOIN l ON node = dst")
def tree_children(spark, d):
    e = down(spark, d)
    return trees.children(e, graph.levels(e)).select("src", "dst", "place")


@query(f"WITH RECURSIVE {DOWN}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS (SELECT node, 0 AS level FROM n UNION SELECT src, level + 1 FROM r JOIN e ON dst = node), l AS (SELECT node, max(level) AS level FROM r GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY node) AS i, max(level) OVER () AS depth FROM l) SELECT level, min(depth) AS depth, count(*) AS n, avg(node) AS mean, median(node) AS median, string_agg(node::VARCHAR, ',' ORDER BY node) FILTER (WHERE i <= 2) AS sample FROM k GROUP BY 1")
def tree_level_statistics(spark, d):
    level = graph.levels(down(spark, d))
    depth = F.broadcast(level.agg(F.max("level").alias("depth")))
    out = level.groupBy("level").agg(F.count("*").alias("n"), F.avg("node").alias("mean"), F.median("node").alias("median"), F.slice(F.array_sort(F.collect_list("node")), 1, 2).alias("sample"))
    return out.crossJoin(depth).withColumn("sample", F.array_join(F.transform("sample", lambda x: x.cast("string")), ","))


@query(f"WITH RECURSIVE {DOWN}, w AS (SELECT 24 AS node, NULL::INT AS parent, 0 AS depth UNION ALL SELECT dst, src, depth + 1 FROM w JOIN e ON src = node WHERE depth < 7), f AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1) SELECT 24 AS root, node, depth, false AS stub FROM f")
def tree_within_budget(spark, d):
    """A tree whose budget is large enough for all of it; small budgets are tested by hand."""
    e = down(spark, d)
    size = e.select(F.col("src").alias("node")).union(e.select("dst")).union(nodes(spark, 24)).distinct().withColumn("chars", F.lit(100))
    return trees.budgeted(e, size, nodes(spark, 24)).select("root", "node", "depth", "stub")


@query("""WITH RECURSIVE f AS (SELECT p_partkey AS node, p_partkey // 3 AS dep, 'f' || p_partkey || '.c' AS file FROM part), r AS (SELECT 100 AS node, 0 AS depth UNION SELECT dep, depth + 1 FROM r JOIN f USING (node) WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def tree_file_dependencies(spark, d):
    """Files that a file includes, to three steps, from the text of its include lines."""
    from ..functions import imports

    k = F.col("p_partkey")
    files = t.table(spark, d, "part", "p_partkey").select(k.alias("node"), F.concat(F.lit('// x\n#include "sub/f'), F.floor(k / 3).cast("string"), F.lit('.c"\n#include <stdio.h>\nint a;\n')).alias("body"))
    scratch.checkpoints(spark)
    named = files.select("node", F.explode(imports.included(F.col("body"), "c")).alias("name")).where(F.col("name") != "stdio.h")
    edges = named.select(F.col("node").alias("src"), F.regexp_extract("name", r"f(\d+)", 1).cast("long").alias("dst")).checkpoint()
    return graph.reached(edges, spark.createDataFrame([(100,)], "node long"), 3)


@query(f"WITH RECURSIVE {DOWN}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS (SELECT node, 0 AS level FROM n UNION SELECT src, level + 1 FROM r JOIN e ON dst = node), l AS (SELECT node, max(level) AS level FROM r GROUP BY 1) SELECT node, row_number() OVER (ORDER BY level DESC, node) AS place FROM l")
def tree_topological_order(spark, d):
    """Callers ahead of what they call; peers by name."""
    return scratch.ranked(graph.levels(down(spark, d)), [F.desc("level"), F.asc("node")], "place").select("node", (F.col("place") + 1).alias("place"))
