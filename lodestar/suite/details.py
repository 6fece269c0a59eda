"""Queries on folders, hunks, seeds, vector collections, flows by kind, reports and work items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folders, graph, knowledge, selection, similarity, traces, trees, vectors
from ..plans import scratch
from ..plans import stand_ins as t
from ..registry import query
from ..sources import files
from .modules import SOME_RINGS
from .selection import DIFFS, PLACES, _diffs, _places


@query("""WITH f AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS p FROM f),
d AS (SELECT array_to_string(p[1:k], '/') AS path, k AS depth FROM (SELECT p, unnest(range(1, len(p))) AS k FROM s))
SELECT path, string_split(path, '/')[-1] AS name, depth, count(*) AS files FROM d WHERE string_split(path, '/')[-1] IN ('en', 'de') GROUP BY 1, 3""")
def folder_by_name(spark, d):
    """Folders named like two languages, with all files below them."""
    return folders.named(_pages(spark, d), spark.createDataFrame([("en",), ("de",)], "name string")).withColumn("depth", F.col("depth").cast("long"))


@query("""WITH f AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages), h AS (SELECT DISTINCT string_split(path, '/')[1] AS root FROM f),
e AS (SELECT path, 'file' AS kind FROM f UNION SELECT array_to_string(string_split(path, '/')[1:k], '/'), 'folder' FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS k FROM f))
SELECT root, path, kind, len(string_split(path, '/')) - 1 AS level FROM e JOIN h ON starts_with(path, root || '/') WHERE len(string_split(path, '/')) - 1 BETWEEN 1 AND 2""")
def folder_listing(spark, d):
    """What stands below each host, two levels deep."""
    f = _pages(spark, d)
    roots = f.select(F.substring_index("path", "/", 1).alias("root"))
    return folders.listing(f, roots, 2).withColumn("level", F.col("level").cast("long"))


def _pages(spark, d):
    return t.table(spark, d, "pages", "url").select(F.regexp_replace("url", "^[a-z]+://|[?#].*$", "").alias("path")).distinct()


@query(f"WITH {DIFFS} SELECT l_orderkey AS diff, file, (k + 1)::INT AS hunk, 1 AS old_first, 1 AS old_last, q::INT AS new_first, q::INT AS new_last FROM x")
def diff_hunks(spark, d):
    """Line ranges of hunks on both sides."""
    return files.hunks(_diffs(spark, d))


@query(f"WITH {DIFFS}, h AS (SELECT l_orderkey AS diff, file, q::INT AS at FROM x) SELECT DISTINCT a.diff, a.file, a.at FROM h a JOIN h b ON b.diff = a.diff AND b.file = a.file AND b.at <> a.at")
def diff_files_with_more_hunks(spark, d):
    """Hunks of files that a diff changes in more than one place."""
    h = files.hunks(_diffs(spark, d)).select("diff", "file", F.col("new_first").alias("at")).distinct()
    more = h.groupBy("diff", "file").agg(F.count("*").alias("n")).where("n > 1")
    return h.join(more, ["diff", "file"], "left_semi")


@query("""WITH i AS (SELECT l_orderkey, l_suppkey, l_quantity::BIGINT AS q, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_suppkey, l_quantity) - 1 AS pos FROM lineitem)
SELECT 's' || l_suppkey AS name, 'lib' || (l_suppkey % 9) AS owner, l_returnflag || '.c' AS source, sum(q)::BIGINT AS cost, count(*) AS frames, max(pos)::INT AS deepest FROM i GROUP BY 1, 2, 3""")
def trace_costs_of_arrays(spark, d):
    """Profiles as arrays of arrays of frames, one an order, summed by frame."""
    item = t.table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber", "l_suppkey", "l_quantity").withColumn("q", F.col("l_quantity").cast("long"))
    frame = F.struct("l_linenumber", "l_suppkey", "l_quantity", F.struct(F.concat(F.lit("s"), "l_suppkey").alias("path"), F.col("q").alias("cost"), F.concat(F.lit("lib"), F.col("l_suppkey") % 9).alias("ownerName"), F.concat("l_returnflag", F.lit(".c")).alias("sourcePath")).alias("f"))
    trace = item.groupBy("l_orderkey", "l_returnflag").agg(F.transform(F.array_sort(F.collect_list(frame)), lambda x: x["f"]).alias("t"))
    docs = trace.groupBy("l_orderkey").agg(F.to_json(F.collect_list("t")).alias("json"))
    got = traces.array_frames(docs, "json")
    return got.groupBy("name", "owner", "source").agg(F.sum("cost").alias("cost"), F.count("*").alias("frames"), F.max("pos").alias("deepest"))


@query(f"""WITH {PLACES}, n AS (SELECT f.*, p_name || chr(10) || p_type AS source, p_size FROM f JOIN part USING (p_partkey)), i AS (SELECT function, file, count(*) AS c FROM n JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 48 GROUP BY 1, 2)
SELECT file || '::' || function AS entity_key, split_part(source, chr(10), 1) || '; depth ' || (p_size % 6) || CASE WHEN c > 0 THEN '; defects: ' || c ELSE '' END AS summary, checksum FROM n LEFT JOIN i USING (function, file) WHERE p_size % 5 <> 2""")
def knowledge_seeds(spark, d):
    """Summaries of tree nodes with code, with the number of their defects."""
    p = t.table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size")
    nodes = _places(spark, d).join(p, "p_partkey").withColumn("source", F.concat(F.lit("// note\n  "), "p_name", F.lit("\n"), "p_type")).withColumn("depth", F.col("p_size") % 6)
    nodes = nodes.withColumn("omitted", F.when(F.col("p_size") % 5 == 2, F.lit("budget")))
    issues = t.table(spark, d, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 48").join(_places(spark, d), F.col("l_partkey") == F.col("p_partkey")).select("function", "file")
    return knowledge.seeded(nodes, issues).select("entity_key", "summary", "checksum")


@query("""WITH s AS (SELECT p_partkey AS id, p_name AS function FROM part), a AS (SELECT DISTINCT p_name AS asked FROM part WHERE p_size = 3 UNION SELECT upper(split_part(p_name, ' ', 1)) FROM part WHERE p_size < 3)
SELECT asked, id, CASE WHEN function = asked THEN 'exact' ELSE 'like' END AS how FROM a JOIN s ON function = asked OR asked NOT IN (SELECT function FROM s) AND contains(lower(function), lower(asked))""")
def knowledge_optimisations(spark, d):
    p = t.table(spark, d, "part", "p_partkey", "p_name", "p_size")
    asked = p.where("p_size = 3").select(F.col("p_name").alias("asked")).union(p.where("p_size < 3").select(F.upper(F.substring_index("p_name", " ", 1)))).distinct()
    return knowledge.optimisations(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("function")), asked)


@query("""WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT *, label % 3 = 0 OR id >= 300 AS fresh FROM e)
SELECT id, fresh, 'doc ' || (CASE WHEN label % 3 = 0 THEN label + 1 ELSE label END) AS document FROM u""")
def vector_collection(spark, d):
    """A collection that is added to twice: only documents that are new or changed are embedded, and the second time none."""
    e = t.table(spark, d, "embeddings")
    docs = lambda label: e.select(F.col("vec_id").alias("id"), F.concat(F.lit("doc "), label).alias("document"), "embedding")
    first = docs(F.col("label")).where("id < 300").withColumn("hash", vectors.content_hash("document")).withColumn("fresh", F.lit(False))
    changed = docs(F.when(F.col("label") % 3 == 0, F.col("label") + 1).otherwise(F.col("label")))
    second = vectors.upserted(first, vectors.to_embed(first, changed).withColumn("fresh", F.lit(True)))
    again = vectors.to_embed(second, changed).withColumn("fresh", F.lit(None).cast("boolean"))
    return vectors.upserted(second, again).select("id", "fresh", "document")


@query("""WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.id AS q, b.id AS id, 1 - (1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))) / 2 AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0 AND b.label % 2 = 0)
SELECT q, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 3""")
def vector_nearest_of_some(spark, d):
    """The nearest vectors among those that meet a condition."""
    e = t.table(spark, d, "embeddings")
    got = similarity.top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), e.where("label % 2 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("u")), 3)
    return got.select("q", "id", "rank")


FLOWS = "f AS (SELECT o_custkey % 50 AS source, l_suppkey AS sink, o_orderpriority AS category, l_linenumber AS length FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 40)"


@query(f"""WITH {FLOWS} SELECT 'flows' AS what, '' AS value, count(*) AS n FROM f UNION ALL SELECT 'sources', '', count(DISTINCT source) FROM f UNION ALL SELECT 'sinks', '', count(DISTINCT sink) FROM f UNION ALL SELECT 'pairs', '', count(DISTINCT (source, sink)) FROM f
UNION ALL SELECT 'length', length::VARCHAR, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM f GROUP BY 2""")
def tree_flow_histograms(spark, d):
    o, i = t.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority"), t.table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity").where("l_quantity > 40")
    f = i.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") % 50).alias("source"), F.col("l_suppkey").alias("sink"), F.col("o_orderpriority").alias("category"), F.col("l_linenumber").alias("length"))
    return trees.flow_statistics(f)


@query(f"""WITH RECURSIVE {t.MODULES_SQL.replace('mods AS', 'every AS')}, mods AS (SELECT * FROM every WHERE {SOME_RINGS.format(div='//')}), nodes AS (SELECT src AS node FROM mods UNION SELECT dst FROM mods), w(root, node, depth) AS (SELECT node, node, 0 FROM nodes UNION ALL SELECT root, dst, depth + 1 FROM w JOIN mods ON src = node WHERE depth < 4),
far(node, n) AS (SELECT node, 0 FROM nodes UNION SELECT src, n + 1 FROM far JOIN mods ON dst = far.node WHERE n < 60), lv AS (SELECT node, CASE WHEN max(n) >= 60 THEN 20 ELSE max(n) END AS level FROM far GROUP BY 1),
c AS (SELECT d.depth, root AS node, count(*) AS lines FROM w JOIN (VALUES (2), (4)) d(depth) ON w.depth <= d.depth GROUP BY 1, 2)
SELECT depth, level, count(*) AS nodes, avg(lines) AS mean, min(lines) AS least, median(lines) AS median, max(lines) AS most FROM c JOIN lv USING (node) GROUP BY 1, 2""")
def module_counts_by_limit(spark, d):
    """Paths down to two limits of depth, by the level of the node."""
    scratch.checkpoints(spark)
    e = t.modules(spark, d).where(SOME_RINGS.format(div="div")).checkpoint()
    return trees.counts_by_limit(e, graph.levels(e).checkpoint(), [2, 4])


@query(f"""WITH RECURSIVE {t.MODULES_SQL}, w AS (SELECT DISTINCT [src] AS p FROM mods WHERE src % 100 = 0 UNION ALL SELECT list_append(p, dst) FROM w JOIN mods ON src = p[-1] WHERE len(p) <= 3 AND NOT list_contains(p, dst)),
{PLACES}, x AS (SELECT array_to_string(p, '>') AS path, unnest(p) AS node, generate_subscripts(p, 1) - 1 AS pos FROM w WHERE len(p) = 4)
SELECT path, pos, function, left(md5(file || ':' || first || '-' || last || ':' || function), 16) AS checksum FROM x JOIN f ON p_partkey = node""")
def module_path_work(spark, d):
    """Paths of four functions with the place and the checksum of each."""
    from ..functions import text

    scratch.checkpoints(spark)
    e = t.modules(spark, d).checkpoint()
    paths = trees.root_paths(e, e.where("src % 100 = 0").select(F.col("src").alias("node")), 3).where(F.size("path") == 4)
    each = paths.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("shown"), F.posexplode("path").alias("pos", "node"))
    sum_ = text.range_checksum(F.col("function"), F.col("file"), F.col("first"), F.col("last"))
    return each.join(_places(spark, d), F.col("node") == F.col("p_partkey")).select(F.col("shown").alias("path"), F.col("pos").cast("long").alias("pos"), "function", sum_.alias("checksum"))


@query("SELECT l_orderkey, l_linenumber, 'lines' || l_linenumber AS lines, coalesce(CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'low' END, 'medium') AS kind, l_shipdate >= TIMESTAMP '1997-01-01' AS newer FROM lineitem WHERE l_quantity > 10")
def report_rows(spark, d):
    """Stored rows in the shape of a report: names, defaults, and the later of two commits."""
    severity = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 20, "low")
    item = t.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").where("l_quantity > 10")
    commit = lambda at, name: F.struct(at.alias("at"), F.lit(name).alias("name"))
    pair = selection.ordered_by_time(commit(F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"), "a"), commit(F.col("l_shipdate").cast("timestamp_ntz"), "b"))
    return item.select("l_orderkey", "l_linenumber", F.concat(F.lit("lines"), "l_linenumber").alias("lines"), F.coalesce(severity, F.lit("medium")).alias("kind"), (pair["newer"]["name"] == "b").alias("newer"))


@query("SELECT o_orderkey AS trace, count(*) AS issues FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1")
def trace_with_issues(spark, d):
    """Traces with at least one issue, whose results are stored as arrays."""
    item = t.table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_quantity")
    bad = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), F.struct("l_quantity"))
    stored = item.groupBy(F.col("l_orderkey").alias("trace")).agg(F.collect_list(bad).alias("issues"))
    return stored.where(F.size("issues") > 0).select("trace", F.size("issues").cast("long").alias("issues"))
