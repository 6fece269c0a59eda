"""Queries on changes: parts are functions of files, items are changed lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes
from ..plans import stand_ins as t
from ..registry import query
from ..sources import files

FUNCTIONS = "fn AS (SELECT 'fn' || p_partkey AS name, 'src/m' || (p_partkey % 5) || '/f' || (p_partkey % 12) || '.c' AS file, (p_partkey % 40) * 12 + 1 AS first, (p_partkey % 40) * 12 + 1 + p_size % 20 AS last FROM part)"
LINES = "ch AS (SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 'src/m' || (l_partkey % 5) || '/f' || (l_partkey % 12) || '.c' ELSE 'f' || (l_partkey % 12) || '.c' END AS file, (l_orderkey % 500)::BIGINT AS line, CASE WHEN l_linenumber % 3 = 0 THEN 'removed' ELSE 'added' END AS kind FROM lineitem WHERE l_quantity > 45)"
WITH = f"WITH {FUNCTIONS}, {LINES}"
HIT = "hit AS (SELECT DISTINCT name, fn.file, line FROM fn JOIN ch ON string_split(fn.file, '/')[-1] = string_split(ch.file, '/')[-1] AND (ends_with(fn.file, ch.file) OR ends_with(ch.file, fn.file)) AND line BETWEEN first AND last)"
CALLS = "ca AS (SELECT DISTINCT 'fn' || l_partkey AS src, 'fn' || (l_suppkey * 7 % 50 + l_partkey % 100) AS dst FROM lineitem WHERE l_quantity > 20)"


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def functions(spark, d):
    k = F.col("p_partkey")
    first = (k % 40) * 12 + 1
    return t.table(spark, d, "part", "p_partkey", "p_size").select(_cat("fn", k).alias("name"), _cat("src/m", k % 5, "/f", k % 12, ".c").alias("file"), first.alias("first"), (first + F.col("p_size") % 20).alias("last"))


def lines(spark, d):
    k = F.col("l_partkey")
    item = t.table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity").where("l_quantity > 45")
    file = F.when(F.col("l_suppkey") % 2 == 0, _cat("src/m", k % 5, "/f", k % 12, ".c")).otherwise(_cat("f", k % 12, ".c"))
    return item.select(file.alias("file"), (F.col("l_orderkey") % 500).alias("line"), F.when(F.col("l_linenumber") % 3 == 0, "removed").otherwise("added").alias("kind")).distinct()


def calls(spark, d):
    item = t.table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity").where("l_quantity > 20")
    return item.select(_cat("fn", F.col("l_partkey")).alias("src"), _cat("fn", F.col("l_suppkey") * 7 % 50 + F.col("l_partkey") % 100).alias("dst")).distinct()


@query(f"{WITH}, {HIT} SELECT name, file, count(*) AS lines, min(line) AS first_line FROM hit GROUP BY 1, 2")
def change_modified_functions(spark, d):
    return changes.modified(lines(spark, d), functions(spark, d)).groupBy("name", "file").agg(F.count("*").alias("lines"), F.min("line").alias("first_line"))


ISSUE = "iss AS (SELECT event_id AS id, 'src/m' || (event_id % 6) || '/f' || (event_id % 12) || '.c' AS file, CASE event_id % 4 WHEN 0 THEN (event_id % 700)::VARCHAR WHEN 1 THEN (event_id % 700 + 3) || '-' || (event_id % 700) WHEN 2 THEN 'size_t n' ELSE (event_id % 700) || '-' || (event_id % 700 + 9) END AS line_number, event_id % 700 AS a FROM events)"


@query(f"{WITH}, {ISSUE} SELECT id FROM iss i WHERE id % 4 = 2 OR EXISTS (SELECT 1 FROM ch WHERE ch.file = i.file AND line BETWEEN a - 2 AND CASE id % 4 WHEN 0 THEN a WHEN 1 THEN a + 3 ELSE a + 9 END + 2)")
def change_near_issues(spark, d):
    k = F.col("event_id")
    a = k % 700
    number = F.when(k % 4 == 0, _cat(a)).when(k % 4 == 1, _cat(a + 3, "-", a)).when(k % 4 == 2, "size_t n").otherwise(_cat(a, "-", a + 9))
    issues = t.table(spark, d, "events", "event_id").select(k.alias("id"), _cat("src/m", k % 6, "/f", k % 12, ".c").alias("file"), number.alias("line_number"))
    return changes.near_changes(issues, lines(spark, d)).select("id")


@query(f"""{WITH}, {HIT}, {CALLS}, m AS (SELECT DISTINCT name FROM hit WHERE line % 9 = 0), e AS (SELECT src, dst FROM ca WHERE src IN (SELECT name FROM fn) AND dst IN (SELECT name FROM fn)),
r AS (SELECT src AS name, dst AS via, 1 AS k FROM e JOIN m ON dst = m.name WHERE src <> dst UNION SELECT dst, src, 2 FROM e JOIN m ON src = m.name WHERE src <> dst)
SELECT name, CASE WHEN name IN (SELECT name FROM m) THEN 'modified' WHEN min(k) = 1 THEN 'calls_modified' ELSE 'called_by_modified' END AS reason, coalesce(string_agg(DISTINCT via, ',' ORDER BY via), '') AS related FROM (SELECT name, via, k FROM r UNION ALL SELECT name, NULL, 9 FROM m) GROUP BY 1""")
def change_affected_functions(spark, d):
    fns = functions(spark, d)
    hit = changes.modified(lines(spark, d), fns).where("line % 9 = 0").select("name").distinct()
    return changes.affected(hit, calls(spark, d), fns).withColumn("related", F.array_join("related", ","))


@query(f"{WITH}, {HIT}, {CALLS}, a AS (SELECT dst AS name, 'callee' AS side FROM ca WHERE src = 'fn7' UNION SELECT src, 'caller' FROM ca WHERE dst = 'fn7') SELECT name, side, name IN (SELECT name FROM hit) AS is_modified FROM a")
def change_related_functions(spark, d):
    return changes.related("fn7", calls(spark, d), changes.modified(lines(spark, d), functions(spark, d)))


@query(f"WITH {FUNCTIONS}, {CALLS} SELECT name, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM ca WHERE dst = name), '') AS invoked_by FROM fn")
def change_reverse_edges(spark, d):
    return changes.callers_of(functions(spark, d).select("name"), calls(spark, d)).withColumn("invoked_by", F.array_join("invoked_by", ","))


HUNKS = "h AS (SELECT s_suppkey AS hunk, 'src/m' || (s_suppkey % 5) || '/f' || (s_suppkey % 12) || '.c' AS file, (s_suppkey * 37 % 450 + 1)::BIGINT AS first, (s_suppkey * 37 % 450 + 1 + s_suppkey % 30)::BIGINT AS last FROM supplier)"


def hunks(spark, d):
    k = F.col("s_suppkey")
    first = k * 37 % 450 + 1
    return t.table(spark, d, "supplier", "s_suppkey").select(k.alias("hunk"), _cat("src/m", k % 5, "/f", k % 12, ".c").alias("file"), first.alias("first"), (first + k % 30).alias("last"))


@query(f"WITH {FUNCTIONS}, {HUNKS} SELECT hunk, h.file, least(h.first, min(fn.first)) AS first, greatest(h.last, max(fn.last)) AS last, greatest(1, h.first - 5) AS padded_first, least(460, h.last + 5) AS padded_last FROM h LEFT JOIN fn ON fn.file = h.file AND fn.first <= h.last AND fn.last >= h.first GROUP BY hunk, h.file, h.first, h.last")
def change_expanded_hunks(spark, d):
    h = hunks(spark, d)
    lo, hi = changes.padded(F.col("first"), F.col("last"), F.lit(460), 5)
    return changes.grown(h, functions(spark, d)).join(h.select("hunk", lo.alias("padded_first"), hi.alias("padded_last")), "hunk")


@query(f"{WITH}, l AS (SELECT file, line, 'code ' || line AS value, bool_or(kind = 'added') AS a, bool_or(kind = 'removed') AS r FROM ch GROUP BY 1, 2) SELECT file, line, CASE WHEN line % 2 = 0 THEN ' ' WHEN a THEN '+' ELSE '-' END || value AS value FROM l")
def change_marked_lines(spark, d):
    ch = lines(spark, d)
    code = ch.select("file", "line").distinct().withColumn("value", _cat("code ", F.col("line")))
    return changes.marked(code, ch.where("line % 2 = 1"))


@query("""WITH a AS (SELECT 'fn' || l_partkey AS name, md5(max(l_quantity)::INT::VARCHAR) AS checksum FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT 'fn' || l_partkey AS name, md5(max(l_quantity)::INT::VARCHAR) AS checksum FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT b.name, b.checksum, CASE WHEN a.name IS NULL THEN 'new' ELSE 'changed' END AS status FROM b LEFT JOIN a ON a.name = b.name WHERE a.name IS NULL OR a.checksum <> b.checksum""")
def change_new_or_changed(spark, d):
    item = t.table(spark, d, "lineitem", "l_partkey", "l_quantity", "l_returnflag")
    side = lambda f: item.where(F.col("l_returnflag") == f).groupBy(_cat("fn", F.col("l_partkey")).alias("name")).agg(F.md5(F.max("l_quantity").cast("int").cast("string")).alias("checksum"))
    return changes.new_or_changed(side("R"), side("A"))


@query(f"WITH {FUNCTIONS}, l AS (SELECT DISTINCT 'src/m' || (event_id % 5) || '/f' || (event_id % 12) || '.c' AS file, event_id % 480 AS line FROM events) SELECT l.file, line, arg_min(name, {{'s': last - first, 'n': name}}) AS name FROM l JOIN fn ON fn.file = l.file AND line BETWEEN first AND last GROUP BY 1, 2")
def change_enclosing_function(spark, d):
    k = F.col("event_id")
    at = t.table(spark, d, "events", "event_id").select(_cat("src/m", k % 5, "/f", k % 12, ".c").alias("file"), (k % 480).alias("line")).distinct()
    return changes.innermost(at, functions(spark, d))


@query("""WITH r AS (SELECT DISTINCT 'C' || (p_partkey % 6) || '::run' || (p_partkey % 50) AS name FROM part), q AS (SELECT DISTINCT 'C' || (event_id % 9) || '::run' || (event_id % 70) AS asked FROM events), b AS (SELECT split_part(name, '::', 2) AS b, min(name) AS name FROM r GROUP BY 1)
SELECT asked, coalesce(r.name, b.name) AS name, CASE WHEN r.name IS NOT NULL THEN 'exact' WHEN b.name IS NOT NULL THEN 'base' END AS how FROM q LEFT JOIN r ON r.name = asked LEFT JOIN b ON b = split_part(asked, '::', 2)""")
def change_resolved_names(spark, d):
    k, e = F.col("p_partkey"), F.col("event_id")
    registry = t.table(spark, d, "part", "p_partkey").select(_cat("C", k % 6, "::run", k % 50).alias("name")).distinct()
    return changes.resolved(t.table(spark, d, "events", "event_id").select(_cat("C", e % 9, "::run", e % 70).alias("asked")).distinct(), registry)


@query("""WITH p AS (SELECT p_partkey, 'f' || (p_partkey % 20) AS file, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+') AS w FROM part), a AS (SELECT p_partkey AS id, file, unnest(list_distinct(w)) AS w FROM p WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS name, file, unnest(list_distinct(w)) AS w FROM p WHERE p_partkey % 2 = 1 OR p_partkey % 5 = 0),
c AS (SELECT id, name, count(*) AS overlap FROM a JOIN b USING (file, w) GROUP BY 1, 2) SELECT id, name, overlap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, name) AS r FROM c) WHERE r = 1""")
def change_best_keyword_match(spark, d):
    from ..functions import text

    k = F.col("p_partkey")
    p = t.table(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", _cat("f", k % 20).alias("file"), text.tokens(F.concat_ws(" ", "p_name", "p_type")).alias("words"))
    return changes.by_keywords(p.where(k % 2 == 0).withColumnRenamed("p_partkey", "id"), p.where((k % 2 == 1) | (k % 5 == 0)).withColumnRenamed("p_partkey", "name"))


@query("SELECT user_id, event_id, expected FROM (SELECT user_id, event_id, event_id % 50 AS n, lag(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id) + 1 AS expected FROM events) WHERE n <> expected")
def change_line_continuity(spark, d):
    e = t.table(spark, d, "events", "event_id", "user_id").withColumn("n", F.col("event_id") % 50)
    return changes.continuous(e, "user_id", "event_id", "n").select("user_id", "event_id", "expected")


@query("SELECT DISTINCT 'm' || n_regionkey AS file, 'n' || n_nationkey AS src, 'c' || (c_custkey % 20) AS dst FROM nation JOIN customer ON c_nationkey = n_nationkey UNION SELECT DISTINCT 'm' || n_regionkey, 'c' || (c_custkey % 20), 'leaf' FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0")
def source_call_graph(spark, d):
    """Call graphs as nested JSON, one entry a file, callees as names or objects."""
    j = t.table(spark, d, "customer", "c_custkey", "c_nationkey").join(t.table(spark, d, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = _cat("c", F.col("c_custkey") % 20)
    callee = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"function":"'), name, F.lit('","functions_invoked":["leaf"]}'))).otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    f = j.groupBy("n_regionkey", "n_nationkey").agg(F.array_join(F.collect_list(callee), ",").alias("c")).select("n_regionkey", F.concat(F.lit('{"function":"n'), F.col("n_nationkey").cast("string"), F.lit('","functions_invoked":['), "c", F.lit("]}")).alias("f"))
    body = F.concat(F.lit('[{"file":"m'), F.col("n_regionkey").cast("string"), F.lit('","functions":['), F.array_join(F.collect_list("f"), ","), F.lit("]}]"))
    return changes.edges_of_files(f.groupBy("n_regionkey").agg(body.alias("body")), "body")


@query("SELECT 'd' || s_suppkey AS diff, 'src/f' || (s_suppkey % 4) || '.c' AS file, s_suppkey + 1 AS line, 'removed' AS kind FROM supplier UNION ALL SELECT 'd' || s_suppkey, 'src/f' || (s_suppkey % 4) || '.c', s_suppkey + 1, 'added' FROM supplier UNION ALL SELECT 'd' || s_suppkey, 'src/f' || (s_suppkey % 4) || '.c', s_suppkey + 2, 'added' FROM supplier UNION ALL SELECT 'd' || s_suppkey, 'src/f' || (s_suppkey % 4) || '.c', s_suppkey + 200, 'added' FROM supplier")
def source_diff_lines(spark, d):
    """Unified diffs, one a supplier, and the lines that they add and remove."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    body = F.array(_cat("--- a/src/f", k % 4, ".c"), _cat("+++ b/src/f", k % 4, ".c"), F.concat(F.lit("@@ -"), s, F.lit(",3 +"), s, F.lit(",4 @@")), F.lit(" same"), F.lit("-old"), F.lit("+new"), F.lit("+more"), _cat("@@ -90 +", k + 200, " @@"), F.lit("+z"))
    return files.changed_lines(t.table(spark, d, "supplier", "s_suppkey").select(_cat("d", k).alias("diff"), F.posexplode(body).alias("pos", "value")))
