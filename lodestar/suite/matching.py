"""Queries on matches by meaning and by what findings mention, and on profiles and call graphs in many small files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import changes, matching, traces
from ..plans import stand_ins as t
from ..registry import query

VECTORS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS s FROM e)"
ALIKE = "1 - least(greatest(1 - list_dot_product(a.v, b.v) / (a.s * b.s), 0), 2) / 2"
CLASS = "CASE WHEN score >= 0.95 THEN 'very_high' WHEN score >= 0.85 THEN 'high' WHEN score >= 0.75 THEN 'medium' WHEN score >= 0.65 THEN 'low' ELSE 'very_low' END"
SEMANTIC = f"""{VECTORS}, s AS (SELECT a.vec_id AS q, b.vec_id AS id, {ALIKE} AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
m AS (SELECT *, {CLASS} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 5 AND round(score, 9) >= 0.68)"""


def _vectors(spark, d):
    return t.table(spark, d, "embeddings")


def _semantic(spark, d):
    e = _vectors(spark, d)
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return asked, matching.semantic_matches(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("u")), 5, 0.68)


@query(f"WITH {SEMANTIC} SELECT q, id, rank, confidence FROM m")
def match_by_meaning(spark, d):
    return _semantic(spark, d)[1].select("q", "id", "rank", "confidence")


@query(f"""WITH {SEMANTIC}, c AS (SELECT vec_id AS q, count(m.q) AS n FROM n LEFT JOIN m ON m.q = vec_id WHERE vec_id % 100 = 0 GROUP BY 1)
SELECT 'queries' AS what, count(*)::BIGINT AS n FROM c UNION ALL SELECT 'matched', count(*) FILTER (WHERE n > 0) FROM c UNION ALL SELECT 'unmatched', count(*) FILTER (WHERE n = 0) FROM c UNION ALL SELECT 'matches', sum(n)::BIGINT FROM c
UNION ALL SELECT 'confidence ' || confidence, count(*) FROM m GROUP BY confidence""")
def match_summary(spark, d):
    asked, found = _semantic(spark, d)
    return matching.match_summary(asked, found)


@query(f"""WITH {VECTORS}, k AS (SELECT * FROM n WHERE vec_id % 20 = 7), q AS (SELECT *, 'f' || (vec_id % 30) AS function_name, 'x' || (label % 5) || '.c' AS file_path, CASE WHEN vec_id % 11 = 0 THEN ' ' ELSE 'i' || (vec_id % 40) END AS issue FROM n WHERE vec_id % 20 <> 7),
s AS (SELECT a.vec_id AS id, b.vec_id AS known, {ALIKE} AS score FROM q a, k b WHERE trim(a.issue) <> ''),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, known) AS r FROM s) WHERE r = 1),
c AS (SELECT DISTINCT 'f' || (vec_id % 30) AS function_name, 'x' || (label % 5) || '.c' AS file_path, 'i' || (vec_id % 40) AS issue FROM n WHERE vec_id % 3 = 0)
SELECT vec_id AS id, known, coalesce(round(score, 9) >= 0.66, false) AS dropped, CASE WHEN round(score, 9) >= 0.66 THEN coalesce(left(md5(c.function_name || c.file_path || c.issue), 8), '') END AS checksum
FROM q LEFT JOIN r ON r.id = vec_id LEFT JOIN c USING (function_name, file_path, issue)""")
def match_known_by_meaning(spark, d):
    """The nearest known false positive of each finding with a text; near ones are dropped, with their function's checksum."""
    k = F.col("vec_id")
    e = _vectors(spark, d).withColumn("function_name", F.concat(F.lit("f"), k % 30)).withColumn("file_path", F.concat(F.lit("x"), F.col("label") % 5, F.lit(".c")))
    issues = e.where("vec_id % 20 <> 7").select(k.alias("id"), F.col("embedding").alias("v"), "function_name", "file_path", F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("i"), k % 40)).alias("issue"), F.lit(None).cast("string").alias("description"))
    known = e.where("vec_id % 20 = 7").select(k.alias("q"), F.col("embedding").alias("v"))
    sums = e.where("vec_id % 3 = 0").withColumn("issue", F.concat(F.lit("i"), k % 40)).withColumn("checksum", F.left(F.md5(F.concat("function_name", "file_path", "issue")), F.lit(8)))
    return matching.known_by_meaning(issues, known, sums, 0.66).select("id", "known", "dropped", "checksum")


MENTIONS = """i AS (SELECT doc_id AS id, 'see src/' || source || '/f' || (doc_id % 50) || '.c in function run' || (doc_id % 30) || ' and [' || (doc_id % 7) || ']' AS description, lang || '/g' || (doc_id % 9) || '.m' AS file_path, '-stepHandler' AS function_name FROM documents)"""


def _mentioning(spark, d):
    k = F.col("doc_id")
    text = F.concat(F.lit("see src/"), "source", F.lit("/f"), k % 50, F.lit(".c in function run"), k % 30, F.lit(" and ["), k % 7, F.lit("]"))
    return t.table(spark, d, "documents", "doc_id", "source", "lang").select(k.alias("id"), text.alias("description"), F.concat("lang", F.lit("/g"), k % 9, F.lit(".m")).alias("file_path"), F.lit("-stepHandler").alias("function_name"))


@query(f"WITH {MENTIONS} SELECT 'file' AS kind, 'f' || (id % 50) || '.c' AS name, id FROM i UNION ALL SELECT 'file', 'g' || (id % 9) || '.m', id FROM i UNION ALL SELECT 'function', 'run' || (id % 30), id FROM i UNION ALL SELECT 'function', 'step', id FROM i")
def match_mentions(spark, d):
    """Files and functions that findings name, in their text or their fields."""
    return matching.mentions(_mentioning(spark, d))


@query("SELECT a.doc_id AS q, b.doc_id AS id, (a.doc_id % 50 = b.doc_id % 50)::BIGINT + (a.doc_id % 9 = b.doc_id % 9)::BIGINT AS files, (a.doc_id % 30 = b.doc_id % 30)::BIGINT AS functions FROM documents a JOIN documents b ON a.doc_id <> b.doc_id AND (a.doc_id % 50 = b.doc_id % 50 OR a.doc_id % 9 = b.doc_id % 9 OR a.doc_id % 30 = b.doc_id % 30) WHERE a.doc_id % 100 = 0")
def match_candidates(spark, d):
    """For every hundredth finding the others that share a file or a function, but for a function that all have."""
    index = matching.mentions(_mentioning(spark, d)).where("name <> 'step'")
    return matching.candidates(index.where("id % 100 = 0").withColumnRenamed("id", "q"), index)


# one profile an order: a root, a frame for each return flag, and the items below it

ITEMS = "i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_suppkey, l_quantity) - 1 AS leaf FROM lineitem)"


@query(f"""WITH {ITEMS} SELECT l_orderkey AS tree, leaf, 's' || l_suppkey || '>' || l_returnflag || '>o' || l_orderkey AS path,
l_quantity::BIGINT || '>' || (sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey, l_returnflag))::BIGINT || '>' || (sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey))::BIGINT AS cost FROM i""")
def source_order_profiles(spark, d):
    """Nested profiles as JSON, one an order, and their paths with the number of each leaf."""
    got = traces.tree_paths(_profiles(spark, d))
    return got.select(F.col("tree").cast("long").alias("tree"), F.col("leaf").cast("long").alias("leaf"), F.array_join("path", ">").alias("path"), F.array_join(F.transform("cost", lambda x: x.cast("string")), ">").alias("cost"))


@query(f"WITH {ITEMS} SELECT l_orderkey AS tree, 's' || l_suppkey AS name FROM i WHERE leaf = 2")
def source_profile_path_by_number(spark, d):
    """The third path of each profile, if it has one."""
    return traces.path_at(_profiles(spark, d), 2).select(F.col("tree").cast("long").alias("tree"), F.get("path", F.lit(0)).alias("name"))


def _profiles(spark, d):
    item = t.table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber", "l_suppkey", "l_quantity").withColumn("q", F.col("l_quantity").cast("long"))
    leaf = F.struct("l_linenumber", "l_suppkey", "l_quantity", F.struct(F.concat(F.lit("s"), "l_suppkey").alias("frameName"), F.col("q").alias("value"), F.lit("app").alias("ownerName")).alias("f"))
    flag = item.groupBy("l_orderkey", "l_returnflag").agg(F.sum("q").alias("value"), F.transform(F.array_sort(F.collect_list(leaf)), lambda x: x["f"]).alias("children"))
    node = F.struct(F.col("l_returnflag").alias("frameName"), "value", F.lit("lib").alias("ownerName"), "children")
    order = flag.groupBy("l_orderkey").agg(F.sum("value").alias("value"), F.array_sort(F.collect_list(node)).alias("children"))  # an order's own
    body = F.to_json(F.struct(F.concat(F.lit("o"), "l_orderkey").alias("frameName"), "value", "children"))
    return order.select(F.col("l_orderkey").cast("string").alias("tree"), body.alias("body"))


@query(f"WITH {t.MODULES_SQL} SELECT DISTINCT 'm' || (src // 5) AS file, 'f' || src AS src, 'f' || dst AS dst FROM mods UNION SELECT 'm' || (src // 5), 'f' || dst, 'leaf' FROM mods WHERE dst % 2 = 0")
def source_module_graphs(spark, d):
    """Call graphs as nested JSON, one a module of five functions, callees as names or objects."""
    name = F.concat(F.lit("f"), "dst")
    callee = F.when(F.col("dst") % 2 == 0, F.concat(F.lit('{"function":"'), name, F.lit('","functions_invoked":["leaf"]}'))).otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    f = t.modules(spark, d).groupBy("src").agg(F.array_join(F.collect_list(callee), ",").alias("c"))
    f = f.select(F.floor(F.col("src") / 5).alias("m"), F.concat(F.lit('{"function":"f'), "src", F.lit('","functions_invoked":['), "c", F.lit("]}")).alias("f"))
    body = F.concat(F.lit('[{"file":"m'), "m", F.lit('","functions":['), F.array_join(F.collect_list("f"), ","), F.lit("]}]"))
    return changes.edges_of_files(f.groupBy("m").agg(body.alias("body")), "body")


@query("SELECT conv_id, turn, coalesce(contains(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), left(trim(text), 100)), false) AND trim(text) <> '' AS used FROM conversations")
def match_context_used_next(spark, d):
    """Whether the next turn holds the first hundred characters of this one, which is how use is told."""
    c = t.table(spark, d, "conversations", "conv_id", "turn", "text")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.coalesce(F.contains(after, F.left(F.trim("text"), F.lit(100))) & (F.trim("text") != ""), F.lit(False)).alias("used"))
