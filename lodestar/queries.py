"""Named queries on the given tables, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as fn
from .operators import findings, graph, profile, search, similarity, store
from .plans import scratch
from .plans import stand_ins as t
from .registry import ORACLE, QUERIES, query  # noqa: F401

# profiles

TREE_SQL = t.FRAMES_SQL + """, t3 AS (SELECT *, own AS total FROM frames WHERE level = 3),
t2 AS (SELECT f.*, f.own + coalesce(s, 0) AS total FROM frames f LEFT JOIN (SELECT parent AS p, sum(total) AS s FROM t3 GROUP BY 1) ON p = node WHERE level = 2),
t1 AS (SELECT f.*, f.own + coalesce(s, 0) AS total FROM frames f LEFT JOIN (SELECT parent AS p, sum(total) AS s FROM t2 GROUP BY 1) ON p = node WHERE level = 1),
t0 AS (SELECT f.*, f.own + coalesce(s, 0) AS total FROM frames f LEFT JOIN (SELECT parent AS p, sum(total) AS s FROM t1 GROUP BY 1) ON p = node WHERE level = 0),
tree AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)"""


@query(f"WITH {TREE_SQL} SELECT level, name, sum(total)::BIGINT AS total, sum(own)::BIGINT AS own, count(*) AS frames, sum(total)::DOUBLE / (SELECT sum(own) FROM frames) AS share FROM tree GROUP BY 1, 2 HAVING sum(total) > 0")
def profile_cost_by_key(spark, d):
    tree = profile.inclusive(t.frames(spark, d))
    whole = F.broadcast(tree.agg(F.sum("own").alias("_w")))
    out = profile.by_key(tree, ["level", "name"], total="total", own="own").where("total > 0").crossJoin(whole)
    return out.select("level", "name", "total", "own", "frames", (F.col("total").cast("double") / F.col("_w")).alias("share"))


@query(f"WITH {TREE_SQL} SELECT a.node, a.total::BIGINT AS total, (a.total - coalesce(s, 0))::BIGINT AS self FROM tree a LEFT JOIN (SELECT parent AS p, sum(total) AS s FROM tree GROUP BY 1) ON p = a.node")
def profile_self_cost(spark, d):
    return profile.self_cost(profile.inclusive(t.frames(spark, d))).select("node", "total", "self")


YEARS_SQL = "SELECT p_brand, p_type, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS cost FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = {} GROUP BY 1, 2"


@query(f"""WITH a AS ({YEARS_SQL.format(1996)}), b AS ({YEARS_SQL.format(1997)})
SELECT p_brand, p_type, a.cost AS cost_a, b.cost AS cost_b, CASE WHEN b.cost IS NULL THEN 'only_a' WHEN a.cost IS NULL THEN 'only_b' ELSE 'both' END AS status,
coalesce(b.cost, 0) - coalesce(a.cost, 0) AS delta FROM a FULL JOIN b USING (p_brand, p_type)""")
def profile_diff(spark, d):
    item, part = t.table(spark, d, "lineitem", "l_partkey", "l_shipdate", "l_extendedprice"), t.table(spark, d, "part", "p_partkey", "p_brand", "p_type")

    def year(y):
        return item.where(F.year("l_shipdate") == y).join(part, item["l_partkey"] == part["p_partkey"]).groupBy("p_brand", "p_type").agg(F.sum(F.floor("l_extendedprice").cast("long")).alias("cost"))

    return profile.compared(year(1996), year(1997), ["p_brand", "p_type"], "cost")


@query("""WITH c AS (SELECT l_partkey AS part, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS cost FROM lineitem GROUP BY 1), s AS (SELECT sum(cost) AS w FROM c)
SELECT part, cost, cost::DOUBLE / w::DOUBLE AS share FROM c, s WHERE cost::DOUBLE / w::DOUBLE >= 0.0001""")
def profile_threshold(spark, d):
    c = t.table(spark, d, "lineitem", "l_partkey", "l_extendedprice").groupBy(F.col("l_partkey").alias("part")).agg(F.sum(F.floor("l_extendedprice").cast("long")).alias("cost"))
    return profile.with_share(c, "cost").where("share >= 0.0001").select("part", "cost", "share")


@query("SELECT count(*) AS parts, count(l) AS covered FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS l FROM lineitem WHERE l_quantity >= 45) ON l = p_partkey")
def profile_coverage(spark, d):
    hit = t.table(spark, d, "lineitem", "l_partkey", "l_quantity").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(1))
    return t.table(spark, d, "part", "p_partkey").join(hit, "p_partkey", "left").agg(F.count("*").alias("parts"), F.count("hit").alias("covered"))


# findings

@query(f"WITH {t.ISSUES_SQL} SELECT severity, category, directory, count(*) AS n, grouping(severity, category, directory)::BIGINT AS g FROM issues GROUP BY GROUPING SETS ((severity), (category), (directory), ())")
def finding_counters(spark, d):
    sets = [[F.col("severity")], [F.col("category")], [F.col("directory")], []]
    return t.issues(spark, d).groupingSets(sets, "severity", "category", "directory").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query(f"WITH {t.ISSUES_SQL} SELECT source, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM issues GROUP BY 1")
def finding_severity_pivot(spark, d):
    return findings.pivoted(t.issues(spark, d), "source", "severity")


CASCADE_SQL = f"""WITH {t.ISSUES_SQL}, c AS (SELECT *, CASE WHEN category NOT IN ('en', 'de') THEN 'category' WHEN regexp_matches(lower(body), 'license') THEN 'pattern' WHEN length(body) < 100 THEN 'length' END AS dropped_at FROM issues)"""


def _cascade(spark, d):
    levels = [("category", ~F.col("category").isin("en", "de")), ("pattern", F.lower("body").rlike("license")), ("length", F.char_length("body") < 100)]
    return findings.cascaded(t.issues(spark, d), levels)


@query(CASCADE_SQL + " SELECT doc_id, severity, dropped_at FROM c")
def finding_cascade(spark, d):
    return _cascade(spark, d).select("doc_id", "severity", "dropped_at")


@query(CASCADE_SQL + " SELECT coalesce(dropped_at, 'kept') AS stage, count(*) AS n FROM c GROUP BY 1")
def finding_cascade_counts(spark, d):
    return _cascade(spark, d).groupBy(F.coalesce("dropped_at", F.lit("kept")).alias("stage")).agg(F.count("*").alias("n"))


@query(f"WITH {t.ISSUES_SQL} SELECT doc_id, severity, CASE WHEN severity IN ('critical', 'high', 'medium', 'low') THEN '' ELSE 'bad severity' END AS problems FROM issues")
def finding_validation(spark, d):
    return t.issues(spark, d).select("doc_id", "severity", F.array_join(findings.problems("title", "severity", "category"), ",").alias("problems"))


@query(f"WITH {t.ISSUES_SQL} SELECT md5(body) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM issues GROUP BY body")
def finding_exact_dedupe(spark, d):
    return t.issues(spark, d).groupBy(F.md5("body").alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(f"WITH {t.ISSUES_SQL} SELECT doc_id, directory, title FROM (SELECT *, row_number() OVER (PARTITION BY directory, severity ORDER BY length(body) DESC, doc_id) AS k FROM issues) WHERE k = 1")
def finding_longest_per_key(spark, d):
    return findings.first_by_key(t.issues(spark, d), ["directory", "severity"], [F.char_length("body").desc(), F.asc("doc_id")]).select("doc_id", "directory", "title")


@query(f"WITH {t.ISSUES_SQL}, p AS (SELECT source AS prefix FROM issues UNION ALL SELECT directory FROM issues) SELECT prefix, count(*) AS n FROM p GROUP BY 1")
def finding_directory_rollup(spark, d):
    return findings.directories(t.issues(spark, d).select("file_path"), "file_path").groupBy("prefix").agg(F.count("*").alias("n"))


@query(f"WITH {t.ISSUES_SQL}, fp AS (SELECT DISTINCT md5(lower(trim(body))) AS h FROM issues WHERE severity = 'low') SELECT doc_id FROM issues WHERE severity <> 'low' AND md5(lower(trim(body))) NOT IN (SELECT h FROM fp)")
def finding_known_false_positives(spark, d):
    i = t.issues(spark, d).withColumn("h", F.md5(F.lower(F.trim("body"))))
    return i.where("severity <> 'low'").join(i.where("severity = 'low'").select("h").distinct(), "h", "left_anti").select("doc_id")


@query(f"WITH {t.ISSUES_SQL} SELECT doc_id, severity FROM issues ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, doc_id LIMIT 50 OFFSET 20")
def finding_page(spark, d):
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 3).otherwise(4)
    return t.issues(spark, d).orderBy(rank, "doc_id").offset(20).limit(50).select("doc_id", "severity")


@query(f"WITH {t.ISSUES_SQL} SELECT i.doc_id FROM issues i WHERE i.source IN ('src0', 'src1') AND NOT EXISTS (SELECT 1 FROM issues b WHERE b.source NOT IN ('src0', 'src1') AND md5(lower(b.body)) = md5(lower(i.body)))")
def finding_baseline_anti_join(spark, d):
    i = t.issues(spark, d).withColumn("sig", F.md5(F.lower("body")))
    return i.where("source IN ('src0', 'src1')").join(i.where("source NOT IN ('src0', 'src1')").select("sig"), "sig", "left_anti").select("doc_id")


# graphs

NODES_SQL = "SELECT n_nationkey AS node FROM nation"


@query(f"WITH {t.CALLS_SQL} SELECT node, (SELECT count(DISTINCT dst) FROM calls WHERE src = node) AS out_degree, (SELECT count(DISTINCT src) FROM calls WHERE dst = node) AS in_degree FROM ({NODES_SQL})")
def graph_degrees(spark, d):
    return graph.degrees(t.table(spark, d, "nation").select(F.col("n_nationkey").alias("node")), t.calls(spark, d))


def _reach_sql(start: int) -> str:
    return f"WITH RECURSIVE {t.CALLS_SQL}, r AS (SELECT {start} AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN calls ON src = node WHERE depth < 30) SELECT node, min(depth) AS depth FROM r GROUP BY 1"


def _stored_calls(spark, d):
    """The calls, with a checkpoint folder for the loops."""
    scratch.checkpoints(spark)
    return t.calls(spark, d).checkpoint()


@query(_reach_sql(3))
def graph_reachable(spark, d):
    return graph.reached(_stored_calls(spark, d), spark.createDataFrame([(3,)], "node int"))


@query(f"""WITH {t.CALLS_SQL}, a AS (SELECT [3, dst] AS p FROM calls WHERE src = 3),
b AS (SELECT list_append(p, dst) AS p FROM a JOIN calls ON src = p[-1] WHERE NOT list_contains(p, dst)), c AS (SELECT list_append(p, dst) AS p FROM b JOIN calls ON src = p[-1] WHERE NOT list_contains(p, dst))
SELECT array_to_string(p, '>') AS path, len(p) - 1 AS edges FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def graph_paths(spark, d):
    got = graph.paths(_stored_calls(spark, d), spark.createDataFrame([(3,)], "node int"), 3)
    return got.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), (F.size("path") - 1).cast("long").alias("edges"))


@query(f"WITH {t.CALLS_SQL} SELECT a.src AS a, a.dst AS b FROM calls a JOIN calls b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def graph_mutual_calls(spark, d):
    return graph.mutual(t.calls(spark, d))


@query(f"""WITH RECURSIVE {t.CALLS_SQL}, r AS (SELECT src AS a, dst AS b FROM calls UNION SELECT a, dst FROM r JOIN calls ON src = b), m AS (SELECT x.a, min(x.b) AS m FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)
SELECT node, least(node, coalesce(m, node)) AS component FROM (SELECT src AS node FROM calls UNION SELECT dst FROM calls) LEFT JOIN m ON a = node""")
def graph_strong_components(spark, d):
    return graph.strong_components(_stored_calls(spark, d))


DOWN_SQL = f"WITH RECURSIVE {t.CALLS_SQL}, e AS (SELECT src, dst FROM calls WHERE dst < src), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"


@query(DOWN_SQL + ", r AS (SELECT node, 0 AS level FROM n UNION SELECT src, level + 1 FROM r JOIN e ON dst = node) SELECT node, max(level) AS level FROM r GROUP BY 1")
def graph_levels(spark, d):
    return graph.levels(_stored_calls(spark, d).where("dst < src"))


@query(DOWN_SQL + ", r AS (SELECT node AS start, node FROM n UNION ALL SELECT start, dst FROM r JOIN e ON src = node) SELECT start AS node, count(*) AS paths FROM r WHERE node NOT IN (SELECT src FROM e) GROUP BY 1")
def graph_path_counts(spark, d):
    e = _stored_calls(spark, d).where("dst < src")
    return graph.path_counts(e, graph.levels(e)).select("node", F.col("paths").cast("long").alias("paths"))


@query(f"""WITH RECURSIVE {t.CALLS_SQL}, n AS (SELECT n_nationkey AS node, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation),
s AS (SELECT i, node, (SELECT list(x) FROM (SELECT dst AS x, src AS y FROM calls UNION SELECT src, dst FROM calls) WHERE y = node AND x < node) AS before FROM n),
k AS (SELECT 0::BIGINT AS i, []::INT[] AS kept UNION ALL SELECT s.i, CASE WHEN list_has_any(kept, coalesce(before, []::INT[])) THEN kept ELSE list_append(kept, node) END FROM k JOIN s ON s.i = k.i + 1)
SELECT node, list_contains((SELECT kept FROM k ORDER BY i DESC LIMIT 1), node) AS kept FROM n""")
def finding_greedy_dedupe(spark, d):
    calls = _stored_calls(spark, d)
    return graph.first_kept(t.table(spark, d, "nation").select(F.col("n_nationkey").alias("node")), calls.select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS hits FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_quantity::BIGINT * 10 BETWEEN p_size * 10 AND p_size * 10 + 9 GROUP BY 1, 2, 3""")
def graph_changed_functions(spark, d):
    changes = t.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), (F.col("l_quantity").cast("long") * 10).alias("line"))
    ranges = t.table(spark, d, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("part"), (F.col("p_size") * 10).cast("long").alias("first"), (F.col("p_size") * 10 + 9).cast("long").alias("last"))
    return graph.in_ranges(changes, ranges, "part", "line", "first", "last").groupBy("l_orderkey", "l_linenumber", F.col("part").alias("l_partkey")).agg(F.count("*").alias("hits"))


@query("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.07)")
def graph_unreferenced(spark, d):
    used = t.table(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_discount").where("l_quantity > 49 AND l_discount > 0.07").select(F.col("l_suppkey").alias("s_suppkey"))
    return t.table(spark, d, "supplier", "s_suppkey").join(used, "s_suppkey", "left_anti")


# similarity and search

@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.vec_id AS q, b.vec_id AS id, 1 - least(greatest(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 0), 2) / 2 AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT q, id, rank, CASE WHEN score >= .99 THEN 'exact' WHEN score >= .85 THEN 'semantic' WHEN score >= .7 THEN 'related' WHEN score >= .6 THEN 'loose' ELSE 'none' END AS match
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 5""")
def similarity_knn(spark, d):
    e = t.table(spark, d, "embeddings")
    got = similarity.top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("u")), 5)
    return got.select("q", "id", "rank", similarity.match_class(F.col("score")).alias("match"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, 'fn_' || (vec_id % 4) || '_' || (vec_id % 5) AS name FROM embeddings),
s AS (SELECT a.vec_id AS q, b.vec_id AS id, a.name AS x, b.name AS y, 1 - least(greatest(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 0), 2) / 2 AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
c AS (SELECT *, list_distinct(string_split(x, '_')) AS p, list_distinct(string_split(y, '_')) AS r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 15),
h AS (SELECT q, id, 0.4::DOUBLE * (CASE WHEN q % 3 = id % 3 THEN 1 WHEN q % 2 = id % 2 THEN 0.5 ELSE 0 END)::DOUBLE + 0.3::DOUBLE * CASE WHEN x = y THEN 1::DOUBLE ELSE 0.3::DOUBLE + 0.3::DOUBLE * len(list_intersect(p, r)) / greatest(len(p), len(r)) END + 0.3::DOUBLE * score AS hybrid FROM c WHERE q % 3 = id % 3 OR q % 2 = id % 2)
SELECT q, id, hybrid_rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(hybrid, 9) DESC, id) AS hybrid_rank FROM h WHERE hybrid >= 0.5) WHERE hybrid_rank <= 5""")
def similarity_hybrid(spark, d):
    e = t.table(spark, d, "embeddings")
    got = similarity.top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("u")), 15)
    name = lambda c: F.concat(F.lit("fn_"), F.col(c) % 4, F.lit("_"), F.col(c) % 5)
    file = F.when(F.col("q") % 3 == F.col("id") % 3, 1.0).when(F.col("q") % 2 == F.col("id") % 2, 0.5).otherwise(0.0)
    scored = got.withColumn("file_score", file).withColumn("function_score", similarity.name_score(name("q"), name("id")))
    return similarity.hybrid(scored).select("q", "id", "hybrid_rank")


@query("""WITH q AS (SELECT DISTINCT item_id AS q, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark),
t AS (SELECT doc_id AS id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY 1, 2),
l AS (SELECT id, sum(tf) AS dl FROM t GROUP BY 1), w AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), f AS (SELECT token, count(*) AS df FROM t GROUP BY 1),
s AS (SELECT q, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM t JOIN f USING (token) JOIN l USING (id) JOIN q USING (token), w GROUP BY 1, 2)
SELECT q, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, id) AS rank FROM s) WHERE rank <= 1""")
def search_bm25(spark, d):
    q = t.table(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")
    docs = t.table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
    return search.bm25(q, docs, 1).select("q", "rank", "id")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%re%' ORDER BY p_partkey LIMIT 100")
def search_like(spark, d):
    return t.table(spark, d, "part", "p_partkey", "p_name").where(F.col("p_name").ilike("%re%")).orderBy("p_partkey").limit(100)


@query("SELECT token, count(DISTINCT p_partkey) AS parts FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS token FROM part) GROUP BY 1")
def search_inverted_index(spark, d):
    return t.table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", F.explode(fn.tokens(F.col("p_name"))).alias("token")).groupBy("token").agg(F.countDistinct("p_partkey").alias("parts"))


# stores

@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def store_upsert(spark, d):
    e = t.table(spark, d, "events", "user_id", "event_type", "event_id", "ts", "value")
    return store.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def store_retention(spark, d):
    return store.retained(t.table(spark, d, "events", "event_id", "user_id", "ts"), "ts", 1).select("event_id", "user_id")


@query("""WITH a AS (SELECT o_custkey AS c, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS c, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 END AS store, coalesce(a.v, b.v) AS value FROM customer LEFT JOIN a ON a.c = c_custkey LEFT JOIN b ON b.c = c_custkey""")
def store_cache_probe(spark, d):
    o = t.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    one = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("value"))
    return store.probed(t.table(spark, d, "customer", "c_custkey"), [one("F"), one("O")], ["c_custkey"], "value")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = d.doc_id % 2")
def store_purge(spark, d):
    docs = t.table(spark, d, "documents", "doc_id").withColumn("checksum", (F.col("doc_id") % 2).cast("int"))
    return store.purged(docs, t.table(spark, d, "labels").select("doc_id", F.col("quality").alias("checksum")), ["doc_id"], "checksum").select("doc_id")


# relational core

@query("SELECT c_custkey, count(o_orderkey) AS analyses, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS running, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def repository_overview(spark, d):
    c, o = t.table(spark, d, "customer", "c_custkey"), t.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("analyses"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.countDistinct(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("running"), F.max("o_orderdate").alias("last"))


SESSION_SQL = "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, sum(round(value * 100)::BIGINT) FILTER (WHERE event_type IN ('click', 'view'))::BIGINT AS usage, count(*) FILTER (WHERE event_type = 'purchase') AS passed, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1, 2"


@query(SESSION_SQL)
def session_totals(spark, d):
    """Usage and analyses of a session, each summed once (no fan-out between them)."""
    e = t.table(spark, d, "events", "user_id", "ts", "event_type", "value")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(F.when(F.col("event_type").isin("click", "view"), cents)).alias("usage"), F.count_if(F.col("event_type") == "purchase").alias("passed"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events")
def rate_window(spark, d):
    e = t.table(spark, d, "events", "event_id", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    exact = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, 0)
    return e.select("event_id", "user_id", F.count("*").over(exact).alias("recent"))


@query("SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'assistant') WHERE k = 1")
def conversation_last_answer(spark, d):
    return t.table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("SELECT key, a, b, CASE WHEN b IS NULL THEN 'only_a' WHEN a IS NULL THEN 'only_b' WHEN a = b THEN 'same' ELSE 'different' END AS status FROM (SELECT l_partkey AS key, max(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) FULL JOIN (SELECT l_partkey AS key, max(l_quantity) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (key)")
def checksum_compare(spark, d):
    i = t.table(spark, d, "lineitem", "l_partkey", "l_quantity", "l_returnflag")
    side = lambda f, c: i.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("key")).agg(F.max("l_quantity").alias(c))
    status = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.col("a") == F.col("b"), "same").otherwise("different")
    return side("A", "a").join(side("R", "b"), "key", "full_outer").withColumn("status", status)


@query("SELECT seen, count(*) AS n FROM (SELECT bit_or(b) AS seen FROM (SELECT l_suppkey AS k, 1 AS b FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 48 UNION ALL SELECT l_suppkey, 2 FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48 UNION ALL SELECT l_suppkey, 4 FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 48) GROUP BY k) GROUP BY 1")
def three_way_membership(spark, d):
    i = t.table(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_quantity").where("l_quantity > 48")
    bit = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "N", 4)
    return i.withColumn("b", bit).where("b IS NOT NULL").groupBy("l_suppkey").agg(F.bit_or("b").alias("seen")).groupBy("seen").agg(F.count("*").alias("n"))


@query("SELECT ext, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM (SELECT 'f' || (p_partkey % 7) AS ext FROM part) GROUP BY 1")
def files_by_extension(spark, d):
    path = F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".f"), (F.col("p_partkey") % 7).cast("string"))
    n = t.table(spark, d, "part", "p_partkey").groupBy(fn.extension(path).alias("ext")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1 HAVING count(*) > 1")
def pages_per_host(spark, d):
    return t.table(spark, d, "pages", "url").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.count("*").alias("pages")).where("pages > 1")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS quantity, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    return t.table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count("*").alias("n"))


from .suite import artifacts, changes, code, details, matching, modules, profiles, scalars, searches, selection, sinks, stores, streams, trees, triage  # noqa: E402, F401 - they add their queries
