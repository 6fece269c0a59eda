"""Queries on the call graph of parts, which has rings and grows with lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, trees
from ..plans import scratch
from ..plans import stand_ins as t
from ..registry import query

COMPONENTS = f"""{t.MODULES_SQL},
reach(a, b) AS (SELECT src, dst FROM mods WHERE src // 5 = dst // 5 UNION SELECT a, dst FROM reach JOIN mods ON src = b WHERE src // 5 = dst // 5),
nodes AS (SELECT src AS node FROM mods UNION SELECT dst FROM mods),
comp AS MATERIALIZED (SELECT node, least(node, coalesce((SELECT min(x.b) FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a = node), node)) AS component FROM nodes),
up AS MATERIALIZED (SELECT DISTINCT a.component AS src, b.component AS dst FROM mods JOIN comp a ON a.node = mods.src JOIN comp b ON b.node = mods.dst WHERE a.component <> b.component),
lv(node, level) AS (SELECT DISTINCT component, 0 FROM comp UNION SELECT up.src, level + 1 FROM lv JOIN up ON up.dst = lv.node)"""


def calls(spark, d):
    scratch.checkpoints(spark)
    return t.modules(spark, d).checkpoint()


def shown(path="path"):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


@query(f"WITH RECURSIVE {COMPONENTS}, l AS (SELECT node AS component, max(level) AS level FROM lv GROUP BY 1), p AS (SELECT component, level, row_number() OVER (ORDER BY level DESC, component) - 1 AS place FROM l) SELECT node, component, level, place FROM comp JOIN p USING (component)")
def module_component_order(spark, d):
    return graph.component_order(calls(spark, d))


#: Calls downwards, and all of every seventh module: some modules have rings, others do not stand above any.
SOME_RINGS = "dst < src OR src {div} 5 % 7 = 3"


@query(f"""WITH RECURSIVE {t.MODULES_SQL}, few AS (SELECT * FROM mods WHERE {SOME_RINGS.format(div='//')}), nodes AS (SELECT src AS node FROM few UNION SELECT dst FROM few),
far(node, n) AS (SELECT node, 0 FROM nodes UNION SELECT src, n + 1 FROM far JOIN few ON dst = far.node WHERE n < 60)
SELECT node, CASE WHEN max(n) >= 60 THEN 20 ELSE max(n) END AS level FROM far GROUP BY 1""")
def module_levels(spark, d):
    """Levels of a graph with some rings: nodes on or above one get the fixed level."""
    return graph.levels(calls(spark, d).where(SOME_RINGS.format(div="div")))


@query(f"WITH RECURSIVE {t.MODULES_SQL}, r(node, depth) AS (SELECT DISTINCT src, 0 FROM mods WHERE src % 100 = 0 UNION SELECT dst, depth + 1 FROM r JOIN mods ON src = node WHERE depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def module_reach(spark, d):
    e = calls(spark, d)
    return graph.reached(e, e.where("src % 100 = 0").select(F.col("src").alias("node")), 4)


@query(f"""WITH RECURSIVE {t.MODULES_SQL}, w AS (SELECT DISTINCT [src] AS p FROM mods WHERE src % 100 = 0 UNION ALL SELECT list_append(p, dst) FROM w JOIN mods ON src = p[-1] WHERE len(p) <= 4 AND NOT list_contains(p, dst))
SELECT array_to_string(p, '>') AS path FROM w WHERE len(p) = 5 OR NOT EXISTS (SELECT 1 FROM mods WHERE src = p[-1] AND NOT list_contains(p, dst))""")
def module_root_paths(spark, d):
    e = calls(spark, d)
    return trees.root_paths(e, e.where("src % 100 = 0").select(F.col("src").alias("node")), 4).select(shown().alias("path"))


@query(f"""WITH RECURSIVE {t.MODULES_SQL}, u AS (SELECT dst AS src, src AS dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM mods) WHERE k <= 3),
w AS (SELECT DISTINCT [dst] AS p FROM mods WHERE dst % 100 = 0 UNION ALL SELECT list_append(p, dst) FROM w JOIN u ON src = p[-1] WHERE len(p) <= 3 AND NOT list_contains(p, dst)),
e AS (SELECT p FROM w WHERE len(p) > 1 AND (len(p) = 4 OR NOT EXISTS (SELECT 1 FROM u WHERE src = p[-1] AND NOT list_contains(p, dst)))),
k AS (SELECT p, row_number() OVER (PARTITION BY p[1] ORDER BY p) AS place FROM e)
SELECT p[1] AS node, place, array_to_string(list_reverse(p), '>') AS chain FROM k WHERE place <= 3""")
def module_ancestor_chains(spark, d):
    e = calls(spark, d)
    return trees.chains(e, e.where("dst % 100 = 0").select(F.col("dst").alias("node")), 3, 3).withColumn("chain", shown("chain"))


@query(f"""WITH RECURSIVE {t.MODULES_SQL}, w AS (SELECT DISTINCT [src] AS p FROM mods WHERE src % 100 = 0 UNION ALL SELECT list_append(p, dst) FROM w JOIN mods ON src = p[-1] WHERE len(p) <= 4 AND NOT list_contains(p, dst))
SELECT p[1] AS root, array_to_string(p, '>') AS path FROM w""")
def module_descendants(spark, d):
    """All children of a node, two at most, four steps down."""
    e = calls(spark, d)
    return trees.descendants(e, e.where("src % 100 = 0").select(F.col("src").alias("node")), 4, 5).select("root", shown().alias("path"))


@query(f"""WITH RECURSIVE {t.MODULES_SQL}, own AS (SELECT p_partkey AS node, p_size::BIGINT AS lines FROM part),
w(root, node, depth) AS (SELECT node, node, 0 FROM own UNION ALL SELECT root, dst, depth + 1 FROM w JOIN mods ON src = node WHERE depth < 3)
SELECT root AS node, sum(lines)::BIGINT AS lines FROM w JOIN own USING (node) GROUP BY 1""")
def module_limited_totals(spark, d):
    own = t.table(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("lines"))
    return trees.limited_totals(calls(spark, d), own, 3)


def _budget_sql(depth: int, chars: int, nodes: int) -> str:
    """Level by level, each level of a root folded in its order of (place of the parent, name)."""
    parts = [f"""{t.MODULES_SQL}, own AS (SELECT p_partkey AS node, 10 * p_size AS c FROM part),
t0 AS (SELECT DISTINCT src AS root, src AS node, NULL::BIGINT AS parent, 0 AS depth, false AS stub, 0::BIGINT AS place FROM mods WHERE src % 100 = 0),
s0 AS (SELECT root, 1::BIGINT AS n, c::BIGINT AS used FROM t0 JOIN own USING (node))"""]
    for k in range(1, depth + 1):
        every = " UNION ALL ".join(f"SELECT root, node FROM t{i}" for i in range(k))
        parts.append(f"""f{k} AS MATERIALIZED (SELECT root, node, place, parent, own.c FROM (
  SELECT root, dst AS node, min(place) AS place, min_by(src, (place, src)) AS parent FROM t{k - 1} JOIN mods ON src = node WHERE NOT stub GROUP BY 1, 2) x JOIN own USING (node)
  WHERE NOT EXISTS (SELECT 1 FROM ({every}) o WHERE o.root = x.root AND o.node = x.node)),
o{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY root ORDER BY place, node) AS i FROM f{k}),
g{k}(root, i, n, used, fits) AS (SELECT root, 0::BIGINT, n, used, false FROM s{k - 1}
  UNION ALL SELECT g.root, o.i, g.n + 1, g.used + CASE WHEN g.used + o.c <= {chars} THEN o.c ELSE 0 END, g.used + o.c <= {chars} FROM g{k} g JOIN o{k} o ON o.root = g.root AND o.i = g.i + 1 WHERE g.n < {nodes}),
t{k} AS MATERIALIZED (SELECT root, node, parent, {k} AS depth, NOT fits AS stub, i - 1 AS place FROM g{k} JOIN o{k} USING (root, i)),
s{k} AS MATERIALIZED (SELECT root, arg_max(n, i) AS n, arg_max(used, i) AS used FROM g{k} GROUP BY 1)""")
    union = " UNION ALL ".join(f"SELECT root, node, parent, depth, stub FROM t{i}" for i in range(depth + 1))
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\n{union}"


@query(_budget_sql(5, 1200, 9))
def module_tree_within_budget(spark, d):
    """Trees whose characters, nodes and depth all run out for some roots."""
    e = calls(spark, d)
    size = t.table(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("node"), (F.col("p_size") * 10).alias("chars"))
    return trees.budgeted(e, size, e.where("src % 100 = 0").select(F.col("src").alias("node")), 5, 1200, 9)
