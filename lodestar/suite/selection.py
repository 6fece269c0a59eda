"""Queries on what is selected by files, on diffs, on registries of several languages and on stores that change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keywords
from ..operators import selection, store
from ..plans import scratch
from ..plans import stand_ins as t
from ..registry import query

# parts as functions: a file for each type and brand, lines by size

PLACES = "f AS (SELECT p_partkey, replace(p_name, ' ', '_') || p_partkey AS function, left(md5(p_name), 8) AS checksum, 'src/' || p_type || '/' || p_brand || '.c' AS file, p_size AS first, p_size + length(p_name) * p_size % 40 AS last FROM part)"


def _places(spark, d):
    p = t.table(spark, d, "part")
    return p.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey").alias("function"), F.left(F.md5("p_name"), F.lit(8)).alias("checksum"), F.concat(F.lit("src/"), "p_type", F.lit("/"), "p_brand", F.lit(".c")).alias("file"), F.col("p_size").alias("first"), (F.col("p_size") + F.length("p_name") * F.col("p_size") % 40).alias("last"))


@query(f"WITH {PLACES} SELECT 'r' || (p_partkey // 20) AS registry, function, CASE WHEN p_partkey // 20 % 2 = 0 THEN checksum END AS checksum, file, first, last FROM f")
def select_locations(spark, d):
    """Registries of functions as JSON, 20 a document, in the newer and the older form."""
    k = F.floor(F.col("p_partkey") / 20)
    place = F.struct(F.col("file").alias("file_name"), F.col("first").alias("start"), F.col("last").alias("end"))
    newer = F.to_json(F.map_from_arrays(F.collect_list("function"), F.collect_list(F.struct("checksum", F.array(place).alias("code")))))
    older = F.concat(F.lit('{"function_to_location":'), F.to_json(F.map_from_arrays(F.collect_list("function"), F.collect_list(F.array(place)))), F.lit("}"))
    docs = _places(spark, d).groupBy(k.alias("k")).agg(newer.alias("a"), older.alias("b"))
    return selection.locations(docs.select(F.concat(F.lit("r"), "k").alias("registry"), F.when(F.col("k") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("json")), "json")


WANTED = "w AS (SELECT DISTINCT file FROM f WHERE last - first > 36 UNION SELECT 'src/none.c')"


@query(f"WITH {PLACES}, {WANTED} SELECT w.file, count(function) AS n, string_agg(first || ':' || function, ',' ORDER BY first, last, function) AS functions FROM w LEFT JOIN f USING (file) GROUP BY 1")
def select_functions_of_files(spark, d):
    f = _places(spark, d)
    files = f.where("last - first > 36").select("file").union(spark.createDataFrame([("src/none.c",)], "file string"))
    got = selection.functions_of_files(f.select("file", "function", "first", "last"), files)
    shown = F.array_join(F.transform("functions", lambda x: F.concat(x["first"], F.lit(":"), x["function"])), ",")
    return got.select("file", F.size("functions").cast("long").alias("n"), F.when(F.size("functions") > 0, shown).alias("functions"))


@query(f"WITH {PLACES}, {WANTED} SELECT f.function, f.file IN (SELECT file FROM w) AS inside FROM f")
def select_inside_files(spark, d):
    """Functions in a list of files, and the others, by semi and anti join; paths with ./ in front are the same."""
    f = _places(spark, d).select("function", "file")
    files = _places(spark, d).where("last - first > 36").select(F.concat(F.lit("./"), "file").alias("file"))
    return selection.in_files(f, files).select("function", F.lit(True).alias("inside")).unionByName(selection.missing_files(f, files).select("function", F.lit(False).alias("inside")))


@query(f"WITH {PLACES} SELECT function, last - first + 1 AS lines FROM f WHERE last - first + 1 BETWEEN 7 AND 30 ORDER BY lines DESC, function, file LIMIT 50")
def select_longest_first(spark, d):
    return selection.longest_first(_places(spark, d), 7, 30, 50).select("function", "lines")


@query(f"WITH {PLACES}, g AS (SELECT DISTINCT file FROM f), w AS (SELECT DISTINCT p_brand || '.c' AS t FROM part WHERE p_size = 50 UNION SELECT 'top/' || file FROM f WHERE first = 49), x AS (SELECT file FROM g WHERE EXISTS (SELECT 1 FROM w WHERE contains(file, t) OR contains(t, file))) SELECT function FROM f JOIN x USING (file)")
def select_touching(spark, d):
    """Graph entries whose file holds a target's path or is held by one."""
    f = _places(spark, d)
    targets = f.where("first = 50").select(F.element_at(F.split("file", "/"), -1).alias("file")).union(f.where("first = 49").select(F.concat(F.lit("top/"), "file")))
    return selection.touching(f.select("file", "function"), targets).select("function")


@query("""WITH r AS (SELECT DISTINCT p_name || ' ' || p_brand AS name, 'h' || p_size || '.h' AS file FROM part), a AS (SELECT DISTINCT p_name AS asked FROM part UNION SELECT DISTINCT upper(p_brand) FROM part UNION SELECT DISTINCT p_name || ' ' || p_brand FROM part WHERE p_size = 7),
e AS (SELECT asked, name, file FROM a JOIN r ON name = asked)
SELECT * FROM e UNION SELECT asked, name, file FROM a JOIN r ON contains(lower(name), lower(asked)) WHERE asked NOT IN (SELECT asked FROM e)""")
def select_class_files(spark, d):
    """Classes by their whole name, else by any part of it in any case."""
    p = t.table(spark, d, "part")
    whole = F.concat_ws(" ", "p_name", "p_brand")
    asked = p.select(F.col("p_name").alias("asked")).union(p.select(F.upper("p_brand"))).union(p.where("p_size = 7").select(whole))
    return selection.class_files(asked, p.select(whole.alias("name"), F.concat(F.lit("h"), "p_size", F.lit(".h")).alias("file")).distinct())


@query("""SELECT p_partkey, array_to_string(list_distinct_in_order, ',') AS words FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [string_split(p_name, ' ')[1], 'do' || p_type, string_split(p_name, ' ')[2]] ELSE ['ns', string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], 'Inner', p_type] END AS list_distinct_in_order FROM part)""")
def select_name_keywords(spark, d):
    """Keywords of names like -[Class part:part:] and ns::Class<X>::run(const Type&, std::vector<Inner>, int)."""
    w = F.split("p_name", " ")
    selector = F.concat(F.lit("-["), w[0], F.lit(" do"), "p_type", F.lit(":"), w[1], F.lit(":"), w[0], F.lit(":]"))
    qualified = F.concat(F.lit("ns::"), w[0], F.lit("<int>::~"), w[1], F.lit("(std::vector< const Inner >, const lib9::"), "p_type", F.lit("&,int*) const"))
    name = F.when(F.col("p_partkey") % 2 == 0, selector).otherwise(qualified)
    return t.table(spark, d, "part").select("p_partkey", F.array_join(keywords.keywords(name, ["LIB9"]), ",").alias("words"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), f AS (SELECT doc_id, x, unnest([1, 2, 3]) AS first, unnest([1, 4, 9]) AS last FROM l)
SELECT 'd' || doc_id AS file, 'f' || first AS function, left(md5(array_to_string(list_slice(x, first, last), chr(10))), 8) AS checksum FROM f WHERE len(x) >= first""")
def select_current_checksums(spark, d):
    """Checksums of functions over the lines that they span now; a function may end beyond its file."""
    docs = t.table(spark, d, "documents", "doc_id", "text")
    file = F.concat(F.lit("d"), "doc_id")
    lines = docs.select(file.alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    spans = F.array(*[F.struct(F.lit(f"f{a}").alias("function"), F.lit(a).alias("first"), F.lit(z).alias("last")) for a, z in ((1, 1), (2, 4), (3, 9))])
    places = docs.select(file.alias("file"), F.explode(spans).alias("p")).select("file", "p.function", "p.first", "p.last")
    return selection.current_checksums(places, lines)


# a diff for each order: a section an item, in a file named by the item's supplier

ENDINGS = ["c", "md", "swift", "txt"]
DIFFS = """i AS (SELECT l_orderkey, l_suppkey, l_partkey, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) - 1 AS k FROM lineitem),
x AS (SELECT *, 'm' || (l_suppkey % 5) || '/s' || l_suppkey || '.' || ['c', 'md', 'swift', 'txt'][l_suppkey % 4 + 1] AS file FROM i)"""


def _diffs(spark, d):
    item = t.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity").withColumn("q", F.col("l_quantity").cast("long"))
    item = scratch.dealt(item, "l_orderkey")  # an item makes six lines
    listed = item.groupBy(F.col("l_orderkey").alias("diff")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "q"))).alias("l"))
    file = lambda x: F.concat(F.lit("m"), x["l_suppkey"] % 5, F.lit("/s"), x["l_suppkey"], F.lit("."), F.get(F.array(*[F.lit(e) for e in ENDINGS]), (x["l_suppkey"] % 4).cast("int")))
    section = lambda x: F.array(F.concat(F.lit("diff --git a/"), file(x), F.lit(" b/"), file(x)), F.concat(F.lit("--- a/"), file(x)), F.concat(F.lit("+++ b/"), file(x)), F.concat(F.lit("@@ -1 +"), x["q"], F.lit(" @@")), F.concat(F.lit("-"), x["l_partkey"]), F.concat(F.lit("+"), F.repeat(F.lit("x"), x["q"].cast("int"))))
    return listed.select("diff", F.posexplode(F.flatten(F.transform("l", section))).alias("pos", "value"))


@query(f"WITH {DIFFS} SELECT l_orderkey AS diff, file, sum(2 + length(l_partkey::VARCHAR) + q)::BIGINT AS size FROM x GROUP BY 1, 2 HAVING sum(2 + length(l_partkey::VARCHAR) + q) >= 40")
def diff_sizes(spark, d):
    return selection.diff_sizes(_diffs(spark, d), 40)


@query(f"WITH {DIFFS}, w AS (SELECT DISTINCT file FROM x WHERE q = 50) SELECT l_orderkey AS diff, unnest(range(6 * k, 6 * k + 6)) AS pos FROM x WHERE file IN (SELECT file FROM w)")
def diff_of_files(spark, d):
    """The sections of allowed files."""
    lines = _diffs(spark, d)
    files = selection.diff_files(lines).where(F.col("value").startswith("@@ -1 +50 ")).select("file")
    return selection.diff_of_files(lines, files).select("diff", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {DIFFS} SELECT l_orderkey AS diff, count(*) * 6 AS lines FROM x WHERE l_suppkey % 4 IN (0, 2) AND l_suppkey % 5 <> 3 GROUP BY 1")
def diff_of_sources(spark, d):
    """The sections of source files outside excluded folders."""
    return selection.diff_of_sources(_diffs(spark, d), excluded=["m3"]).groupBy("diff").agg(F.count("*").alias("lines"))


# three languages, by return flag

LANGUAGES = "e AS (SELECT DISTINCT l_returnflag AS lang, l_suppkey AS src, l_partkey % 200 AS dst FROM lineitem WHERE l_quantity > 20)"


def _languages(spark, d):
    item = t.table(spark, d, "lineitem", "l_returnflag", "l_suppkey", "l_partkey", "l_quantity").where("l_quantity > 20")
    one = lambda f: item.where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 200).alias("dst"))
    return {f: one(f) for f in ("A", "N", "R")}


@query(f"WITH {LANGUAGES} SELECT src, dst, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM e GROUP BY 1, 2")
def united_graphs(spark, d):
    """The call graphs of all languages, and which of them have each call."""
    return selection.united(_languages(spark, d), ["src", "dst"]).select("src", "dst", F.array_join("parts", ",").alias("languages"))


@query(f"WITH {LANGUAGES} SELECT src, count(DISTINCT dst) AS callees, min(dst) AS first, max(dst) AS last FROM e GROUP BY 1")
def united_callees(spark, d):
    got = selection.outgoing(selection.united(_languages(spark, d), ["src", "dst"]))
    return got.select("src", F.size("callees").cast("long").alias("callees"), F.element_at("callees", 1).alias("first"), F.element_at("callees", -1).alias("last"))


@query("SELECT p_name AS name, count(DISTINCT (p_type || '.h', p_size, p_size + 5)) AS places FROM part WHERE p_partkey % 4 <> 3 OR p_size < 20 GROUP BY 1")
def united_types(spark, d):
    """Types of two registries that overlap, the places of equal names together."""
    p = t.table(spark, d, "part").withColumn("file", F.concat("p_type", F.lit(".h"))).withColumn("last", F.col("p_size") + 5)
    one = lambda w: p.where(w).select(F.col("p_name").alias("name"), "file", F.col("p_size").alias("first"), "last")
    got = selection.united_types({"a": one("p_partkey % 4 <> 3"), "b": one("p_size < 20")})
    return got.select("name", F.size("places").cast("long").alias("places"))


@query(f"WITH {t.MODULES_SQL}, n AS (SELECT src AS node FROM mods UNION SELECT dst FROM mods) SELECT node, coalesce(bool_or(p_size > 25), false) AS external FROM n LEFT JOIN part ON p_partkey = node AND p_size % 2 = 1 GROUP BY 1")
def tree_flags(spark, d):
    """Nodes with a flag from an analysis that does not know all of them."""
    e = t.modules(spark, d)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    flags = t.table(spark, d, "part", "p_partkey", "p_size").where("p_size % 2 = 1").select(F.col("p_partkey").alias("node"), (F.col("p_size") > 25).alias("flag"))
    return selection.flagged(nodes, flags, "external")


# stores that change

ASKED = "a AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderstatus || o_orderpriority AS handle FROM orders WHERE o_custkey % 3 = 0)"
KNOWN = "b AS (SELECT c_custkey AS k, c_mktsegment AS handle FROM customer WHERE c_custkey % 2 = 0)"


def _accounts(spark, d):
    known = t.table(spark, d, "customer", "c_custkey", "c_mktsegment").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("handle"))
    asked = t.table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority").where("o_custkey % 3 = 0")
    return known, asked.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.concat("o_orderstatus", "o_orderpriority").alias("handle"))


@query(f"WITH {ASKED}, {KNOWN} SELECT a.k, seq, coalesce(lag(a.handle) OVER (PARTITION BY a.k ORDER BY seq), b.handle, a.handle) AS handle, lag(seq) OVER (PARTITION BY a.k ORDER BY seq) IS NULL AND b.k IS NULL AS created FROM a LEFT JOIN b ON b.k = a.k")
def account_got_or_created(spark, d):
    return store.got_or_created(*_accounts(spark, d), ["k"], "seq")[0]


@query(f"WITH {ASKED}, {KNOWN}, n AS (SELECT k, arg_max(handle, seq) AS handle FROM a GROUP BY 1) SELECT coalesce(n.k, b.k) AS k, coalesce(n.handle, b.handle) AS handle FROM n FULL JOIN b ON b.k = n.k")
def account_table_after(spark, d):
    return store.got_or_created(*_accounts(spark, d), ["k"], "seq")[1]


@query("""WITH n AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'), c AS (SELECT o_custkey, count(*) AS t, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders WHERE o_custkey IN (SELECT o_custkey FROM n) GROUP BY 1)
SELECT c_custkey AS o_custkey, coalesce(t, -1) AS total, coalesce(f, -1) AS f, coalesce(o, -1) AS o FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def store_bulk_insert(spark, d):
    """Results added to those there are; counts of the analyses that got some are made anew, others stay as they were."""
    orders = t.table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderdate")
    split = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    parents = t.table(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("o_custkey"), *[F.lit(-1).cast("long").alias(c) for c in ("total", "f", "o")])
    return store.inserted(orders.where(~split), orders.where(split), parents, "o_custkey", "o_orderstatus", ["f", "o"])[1]


@query("SELECT p.page_id, md5(p.html) AS md5 FROM pages p WHERE p.page_id % 3 = 0 OR length(p.html) % 2 = 1")
def store_changed_content(spark, d):
    """Files that an index does not have, or has with other content."""
    now = t.table(spark, d, "pages", "page_id", "html").select(F.col("page_id").alias("path"), F.md5("html").alias("md5"), F.length("html").alias("n"))
    index = now.where("path % 3 <> 0").select("path", F.when(F.col("n") % 2 == 1, F.lit("old")).otherwise(F.col("md5")).alias("md5"))
    return store.changed_content(index, now).select(F.col("path").alias("page_id"), "md5")


@query("""WITH f AS (SELECT doc_id, 'run' || doc_id || '_' || lang || (doc_id % 7) || '_abc_analysis' AS name, source || '/' || lang || '/' || lang || (doc_id % 7) || '.c' AS file_path FROM documents)
SELECT doc_id, CASE WHEN doc_id % 7 < 3 AND file_path LIKE '%/en/%' THEN 'en/en' || (doc_id % 7) || '.c' WHEN doc_id % 7 = 5 AND file_path LIKE 'src1/%' THEN file_path END AS source FROM f""")
def store_moved_false_positives(spark, d):
    """Result files that belong to sources with false positives, by path and by name."""
    k = F.col("doc_id") % 7
    files = t.table(spark, d, "documents", "doc_id", "lang", "source").select("doc_id", F.concat(F.lit("run"), "doc_id", F.lit("_"), "lang", k, F.lit("_abc_analysis")).alias("name"), F.concat_ws("/", "source", "lang", F.concat("lang", k, F.lit(".c"))).alias("file_path"))
    sources = files.where((k < 3) & F.contains("file_path", F.lit("/en/"))).select(F.substring_index("file_path", "/", -2).alias("path")).union(files.where((k == 5) & F.col("file_path").startswith("src1/")).select("file_path"))
    return store.moved(files, sources).select("doc_id", "source")
