"""Queries on traces: each order is a trace, its items are the frames, leaf first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, traces
from ..plans import stand_ins as t
from ..registry import query

TRACES = """f AS (SELECT l_orderkey AS trace, l_linenumber::INT AS n, l_partkey AS p, l_suppkey AS s, floor(l_extendedprice)::BIGINT AS cost FROM lineitem),
tr AS (SELECT trace, list_transform(list_sort(list({'n': n, 'p': p, 's': s, 'cost': cost})), lambda x: {'name': CASE x.p % 41 WHEN 0 THEN '???' WHEN 1 THEN ' ' WHEN 2 THEN '<root>' ELSE 'fn_' || (x.p % 300) END, 'owner': CASE x.s % 9 WHEN 0 THEN '' ELSE 'lib' || (x.s % 9) END, 'source': 'src' || (x.s % 5) || '/f' || (x.p % 60) || '.c', 'cost': x.cost}) AS frames FROM f GROUP BY 1)"""
FRAMES = TRACES + ", fr AS (SELECT trace, f.name AS name, f.owner AS owner, f.source AS source, f.cost AS cost FROM (SELECT trace, unnest(frames) AS f FROM tr))"


def trace_rows(spark, d):
    item = t.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    one = F.struct(F.col("l_linenumber").cast("int").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.floor("l_extendedprice").cast("long").alias("cost"))
    name = lambda x: F.when(x["p"] % 41 == 0, "???").when(x["p"] % 41 == 1, " ").when(x["p"] % 41 == 2, "<root>").otherwise(F.concat(F.lit("fn_"), (x["p"] % 300).cast("string")))
    owner = lambda x: F.when(x["s"] % 9 == 0, "").otherwise(F.concat(F.lit("lib"), (x["s"] % 9).cast("string")))
    source = lambda x: F.concat(F.lit("src"), (x["s"] % 5).cast("string"), F.lit("/f"), (x["p"] % 60).cast("string"), F.lit(".c"))
    frame = lambda x: F.struct(name(x).alias("name"), owner(x).alias("owner"), source(x).alias("source"), x["cost"].alias("cost"))
    return item.groupBy(F.col("l_orderkey").alias("trace")).agg(F.transform(F.array_sort(F.collect_list(one)), frame).alias("frames"))


def frame_rows(spark, d):
    return trace_rows(spark, d).select("trace", F.explode("frames").alias("f")).select("trace", "f.*")


NESTED = """SELECT r_name AS tree, 'c' || c_custkey || '>' || 'n' || n_nationkey || '>' || r_name AS path,
floor(abs(c_acctbal))::BIGINT || '>' || sum(floor(abs(c_acctbal))::BIGINT) OVER (PARTITION BY n_nationkey)::BIGINT || '>' || sum(floor(abs(c_acctbal))::BIGINT) OVER (PARTITION BY r_regionkey)::BIGINT AS cost
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query(NESTED)
def trace_paths_of_nested_profile(spark, d):
    """Nested profiles as JSON, one a region, and the paths in them."""
    c = t.table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").withColumn("v", F.floor(F.abs("c_acctbal")).cast("long"))
    leaf = F.struct(F.concat(F.lit("c"), "c_custkey").alias("frameName"), F.col("v").alias("value"), F.lit("app").alias("ownerName"))
    n = c.groupBy("c_nationkey").agg(F.sum("v").alias("v"), F.collect_list(leaf).alias("children"))
    n = n.join(t.table(spark, d, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    node = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("frameName"), F.col("v").alias("value"), F.lit("lib").alias("ownerName"), "children")
    r = n.groupBy("n_regionkey").agg(F.sum("v").alias("v"), F.collect_list(node).alias("children")).join(t.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.to_json(F.struct(F.col("r_name").alias("frameName"), F.col("v").alias("value"), "children"))
    paths = traces.tree_paths(r.select(F.col("r_name").alias("tree"), body.alias("body")))
    return paths.select("tree", F.array_join("path", ">").alias("path"), F.array_join(F.transform("cost", lambda x: x.cast("string")), ">").alias("cost"))


@query(f"WITH {TRACES} SELECT trace, len(list_filter(frames, lambda f: f.owner <> '' AND f.owner IN ('lib1', 'lib3'))) > 0 AS by_owner, len(list_filter(frames, lambda f: contains(f.name, '_7') OR contains(f.name, '_29'))) > 0 AS by_name FROM tr")
def trace_filters(spark, d):
    return trace_rows(spark, d).select("trace", traces.any_owner(F.col("frames"), ["lib1", "lib3"]).alias("by_owner"), traces.any_name(F.col("frames"), ["_7", "_29"]).alias("by_name"))


@query(f"WITH {FRAMES} SELECT name, count(*) AS n, bool_and(trim(name) NOT IN ('', '???', '<root>', '<unnamed>')) AS function, bool_and(trim(name) NOT IN ('', '???')) AS shown, bool_and(trim(name) NOT IN ('', '???', '<root>')) AS shown_below_root FROM fr GROUP BY 1")
def trace_frame_validity(spark, d):
    n = F.col("name")
    return frame_rows(spark, d).groupBy("name").agg(F.count("*").alias("n"), F.bool_and(traces.known_function(n)).alias("function"), F.bool_and(traces.shown_frame(n)).alias("shown"), F.bool_and(traces.shown_frame(n, False)).alias("shown_below_root"))


@query(f"WITH {TRACES}, w AS (SELECT sum(frames[1].cost) AS w FROM tr) SELECT trace, frames[1].cost * 1000000.0::DOUBLE / w >= 700 AS leaf, list_max(list_transform(frames, lambda f: f.cost)) * 1000000.0::DOUBLE / w >= 900 AS highest FROM tr, w")
def trace_thresholds(spark, d):
    rows = trace_rows(spark, d)
    whole = F.broadcast(rows.agg(F.sum(traces.leaf_cost(F.col("frames"))).alias("w")))  # one row
    return rows.crossJoin(whole).select("trace", (traces.leaf_cost(F.col("frames")) * 1_000_000.0 / F.col("w") >= 700).alias("leaf"), (traces.highest_cost(F.col("frames")) * 1_000_000.0 / F.col("w") >= 900).alias("highest"))


@query(f"WITH {TRACES}, k AS (SELECT trace, len(frames) AS n, row_number() OVER (ORDER BY trace) AS r, count(*) OVER () AS c FROM tr WHERE len(frames) BETWEEN 3 AND 5) SELECT trace, n FROM k WHERE r > floor(0.1::DOUBLE * c) AND r <= c - floor(0.2::DOUBLE * c)")
def trace_position_slice(spark, d):
    rows = trace_rows(spark, d).select("trace", F.size("frames").cast("long").alias("n")).where("n BETWEEN 3 AND 5")
    return traces.position_slice(rows, ["trace"], 0.1, 0.2)


@query(f"WITH {TRACES} SELECT trace, array_to_string(list_transform(list_reverse(frames), lambda f: f.name || '@' || f.owner || ':' || f.cost), '|') AS frames FROM tr")
def trace_projection(spark, d):
    shown = F.transform(F.reverse("frames"), lambda f: F.concat(f["name"], F.lit("@"), f["owner"], F.lit(":"), f["cost"].cast("string")))
    return trace_rows(spark, d).select("trace", F.array_join(shown, "|").alias("frames"))


@query(f"WITH {FRAMES} SELECT DISTINCT owner FROM fr WHERE owner <> ''")
def trace_owners(spark, d):
    return frame_rows(spark, d).where("owner <> ''").select("owner").distinct()


@query(f"WITH {TRACES} SELECT count(*) AS traces, count(*) FILTER (WHERE len(list_filter(frames, lambda f: f.owner = 'lib2')) > 0) AS kept FROM tr")
def trace_counts(spark, d):
    return trace_rows(spark, d).agg(F.count("*").alias("traces"), F.count_if(traces.any_owner(F.col("frames"), ["lib2"])).alias("kept"))


@query(f"WITH {FRAMES}, a AS (SELECT name, owner, source, sum(cost)::BIGINT AS cost, count(*) AS frames FROM fr WHERE owner <> '' GROUP BY 1, 2, 3) SELECT *, floor(cost * 1000000::DOUBLE / (SELECT sum(cost) FROM a))::BIGINT AS ppm FROM a")
def trace_costs_strict(spark, d):
    """Arrays of frames exploded and summed by the three-part key, with parts per million."""
    return traces.by_function(frame_rows(spark, d).where("owner <> ''"), ["name", "owner", "source"])


@query(f"WITH {FRAMES} SELECT name, owner, sum(cost)::BIGINT AS cost, min(source) AS source, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM fr GROUP BY 1, 2")
def trace_costs_liberal(spark, d):
    return traces.liberal(frame_rows(spark, d)).withColumn("sources", F.array_join("sources", ","))


@query(f"WITH {FRAMES}, a AS (SELECT name, owner, source, sum(cost)::BIGINT AS total, min(cost)::BIGINT AS own FROM fr GROUP BY 1, 2, 3), w AS (SELECT sum(total) AS w FROM a) SELECT name, owner, source, total, own FROM a, w WHERE own * 1.0::DOUBLE / w >= 0.00001 OR total * 1.0::DOUBLE / w >= 0.0005")
def trace_low_cost_drop(spark, d):
    a = frame_rows(spark, d).groupBy("name", "owner", "source").agg(F.sum("cost").alias("total"), F.min("cost").alias("own"))
    w = F.broadcast(a.agg(F.sum("total").alias("w")))
    return a.crossJoin(w).where(profile.worth_keeping(F.col("own") * 1.0 / F.col("w"), F.col("total") * 1.0 / F.col("w"), 1e-5, 5e-4)).select("name", "owner", "source", "total", "own")


@query(f"WITH {TRACES} SELECT trace, m AS cost FROM (SELECT trace, list_max(list_transform(frames, lambda f: f.cost)) AS m FROM tr) ORDER BY m DESC, trace LIMIT 50 OFFSET 100")
def trace_batch(spark, d):
    return traces.batch(trace_rows(spark, d).select("trace", traces.highest_cost(F.col("frames")).alias("cost")), [F.desc("cost"), "trace"], 50, 2)


@query(f"WITH {FRAMES} SELECT DISTINCT trace FROM (SELECT name, min(trace) AS trace FROM fr GROUP BY 1)")
def trace_coverage_sample(spark, d):
    return traces.first_per_function(frame_rows(spark, d))


@query(f"WITH {TRACES} SELECT trace FROM tr WHERE len(list_filter(frames, lambda f: contains(f.name, 'fn_12'))) > 0 ORDER BY trace LIMIT 7")
def trace_first_matches(spark, d):
    return trace_rows(spark, d).where(traces.any_name(F.col("frames"), ["fn_12"])).orderBy("trace").limit(7).select("trace")


@query(f"WITH {TRACES} SELECT trace FROM tr ORDER BY md5('7:' || trace), trace LIMIT 25")
def trace_sample(spark, d):
    return traces.sampled(trace_rows(spark, d), "trace", 25, 7).select("trace")


@query(f"WITH {TRACES} SELECT trace, frames[1].cost AS cost FROM tr ORDER BY cost DESC, trace LIMIT 40")
def trace_sorted_by_leaf(spark, d):
    return trace_rows(spark, d).select("trace", traces.leaf_cost(F.col("frames")).alias("cost")).orderBy(F.desc("cost"), "trace").limit(40)


@query(f"WITH {TRACES}, n AS (SELECT count(*) AS n FROM tr) SELECT trace, ((row_number() OVER (ORDER BY trace) - 1) // ceil(n / 4.0::DOUBLE)::BIGINT)::BIGINT AS slice FROM tr, n")
def trace_slices(spark, d):
    """The slice of each trace where traces are written to four files of equally many."""
    from ..sources import text_sinks

    return text_sinks.sliced(trace_rows(spark, d).select("trace"), ["trace"], 4)


@query(f"WITH {TRACES} SELECT md5(array_to_string(list_transform(frames, lambda f: concat_ws(' ', f.owner, f.name, '(' || f.source || ')', f.cost::VARCHAR)), chr(10)))[:12] AS callstack, count(*) AS traces, min(trace) AS first FROM tr GROUP BY 1")
def trace_callstack_groups(spark, d):
    """Equal call stacks share an id of twelve characters."""
    return trace_rows(spark, d).groupBy(F.left(F.md5(traces.text_lines(F.col("frames"))), F.lit(12)).alias("callstack")).agg(F.count("*").alias("traces"), F.min("trace").alias("first"))


DIFF = """a AS (SELECT l_partkey % 500 AS fn, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS cost FROM lineitem WHERE year(l_shipdate) = 1995 GROUP BY 1),
b AS (SELECT l_partkey % 500 AS fn, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS cost FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY 1)"""


@query(f"""WITH {DIFF}, j AS (SELECT fn, coalesce(a.cost, 0) AS cost_a, coalesce(b.cost, 0) AS cost_b FROM a FULL JOIN b USING (fn))
SELECT fn, cost_a, cost_b, cost_b - cost_a AS delta, CASE WHEN cost_a = 0 THEN CASE WHEN cost_b > 0 THEN 100 ELSE 0 END ELSE (cost_b - cost_a) * 100.0::DOUBLE / cost_a END AS percent FROM j ORDER BY abs(cost_b - cost_a) DESC, fn LIMIT 100""")
def trace_profile_diff(spark, d):
    item = t.table(spark, d, "lineitem", "l_partkey", "l_shipdate", "l_extendedprice")
    year = lambda y: item.where(F.year("l_shipdate") == y).groupBy((F.col("l_partkey") % 500).alias("fn")).agg(F.sum(F.floor("l_extendedprice").cast("long")).alias("cost"))
    both = profile.compared(year(1995), year(1998), ["fn"], "cost").fillna(0, ["cost_a", "cost_b"])
    percent = F.when(F.col("cost_a") == 0, F.when(F.col("cost_b") > 0, 100.0).otherwise(0.0)).otherwise(F.col("delta") * 100.0 / F.col("cost_a"))
    return both.withColumn("percent", percent).orderBy(F.abs("delta").desc(), "fn").limit(100).select("fn", "cost_a", "cost_b", "delta", "percent")


@query(f"WITH {FRAMES} SELECT source, count(DISTINCT trace) AS traces FROM fr WHERE contains(name, 'fn_2') GROUP BY 1")
def trace_function_lookup(spark, d):
    return frame_rows(spark, d).where(F.contains("name", F.lit("fn_2"))).groupBy("source").agg(F.countDistinct("trace").alias("traces"))
