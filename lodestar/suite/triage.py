"""Queries on findings: filters, scopes, baselines, directories, counters, text sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import findings, search, triage
from ..plans import stand_ins as t
from ..registry import query
from ..sources import reports

I = f"WITH {t.ISSUES_SQL}"  # noqa: E741


@query("SELECT doc_id, trim(' ' || lang || ' ') IN ('en', 'de') AS kept FROM documents")
def triage_categories(spark, d):
    docs = t.table(spark, d, "documents", "doc_id", "lang")
    return docs.select("doc_id", triage.allowed_category(F.concat(F.lit(" "), "lang", F.lit(" ")), ("en", "de")).alias("kept"))


SAID = """s AS (SELECT event_id AS k, ['none.', 'No measurable impact here', 'slow', 'impact is zero', 'minimal'][event_id % 5 + 1] AS impact,
['fix it', 'No action required', 'n/a', 'cache it'][event_id % 4 + 1] AS solution, ['bug', 'no issues found', 'works as intended', 'this is normal', 'leak', 'expected behavior', 'race'][event_id % 7 + 1] AS issue FROM events)"""


@query(f"""WITH {SAID} SELECT k, CASE WHEN k % 5 IN (0, 1, 3, 4) THEN 'impact' WHEN k % 4 IN (1, 2) THEN 'solution' WHEN k % 7 IN (1, 3, 5) THEN 'issue' END AS reason FROM s""")
def triage_no_consequence(spark, d):
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % len(v)).cast("int"))
    s = t.table(spark, d, "events", "event_id")
    reason = triage.no_consequence(pick("none.", "No measurable impact here", "slow", "impact is zero", "minimal"), pick("fix it", "No action required", "n/a", "cache it"), pick("bug", "no issues found", "works as intended", "this is normal", "leak", "expected behavior", "race"))
    return s.select(F.col("event_id").alias("k"), reason.alias("reason"))


@query(f"""{I}, c AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'unknown' ELSE left(md5(body), 8) END AS checksum FROM issues), k AS (SELECT DISTINCT checksum AS c, lower(trim(body)) AS b FROM c WHERE severity = 'low' AND checksum <> 'unknown')
SELECT doc_id FROM c WHERE severity <> 'low' AND NOT EXISTS (SELECT 1 FROM k WHERE k.c = checksum AND b = lower(trim(body)))""")
def triage_known_false_positives(spark, d):
    """By checksum and whole text."""
    c = t.issues(spark, d).withColumn("checksum", F.when(F.col("doc_id") % 13 == 0, "unknown").otherwise(F.left(F.md5("body"), F.lit(8))))
    return triage.without_known(c.where("severity <> 'low'"), c.where("severity = 'low'"), title="body").select("doc_id")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), k AS (SELECT * FROM e WHERE vec_id % 50 = 7), q AS (SELECT * FROM e WHERE vec_id % 50 <> 7),
s AS (SELECT q.vec_id AS q, k.vec_id AS known, 1 - (1 - list_dot_product(q.v, k.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(k.v, k.v)))) / 2 AS score FROM q, k)
SELECT q, known, score >= 0.66 AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, known) AS r FROM s) WHERE r = 1""")
def triage_nearest_false_positive(spark, d):
    """The nearest known false positive of each finding, and whether it is near enough to drop it."""
    from ..operators import similarity

    e = t.table(spark, d, "embeddings", "vec_id", "embedding")
    best = similarity.top_k(e.where("vec_id % 50 = 7").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), e.where("vec_id % 50 <> 7").select(F.col("vec_id").alias("id"), F.col("embedding").alias("u")), 1, turned=True)
    return best.select(F.col("id").alias("q"), F.col("q").alias("known"), (F.col("score") >= 0.66).alias("dropped"))


SCOPE = "'src/m' || (p_partkey % 4) || '/d' || (p_partkey % 5) || '/f' || (p_partkey % 6) || '.c'"


@query(f"""WITH p AS (SELECT p_partkey AS k, './' || {SCOPE} AS path, p_partkey % 4 AS m, p_partkey % 5 AS e, p_partkey % 6 AS f FROM part)
SELECT k, NOT (f = 3) AND m = 1 AND e <> 2 AS first, NOT (m = 0 OR e = 4) AS second FROM p""")
def triage_scope(spark, d):
    """Include src/m1 and m2; exclude d2 inside m1, src (inside which src/m1 stands, but not m2 by itself), and f3.c."""
    p = t.table(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("k"), F.concat(F.lit("./"), F.expr(SCOPE)).alias("path"))
    first = triage.in_scope(F.col("path"), ["src/m1", "m2"], ["src/m1/d2", "src"], ["f3.c"])
    return p.select("k", first.alias("first"), triage.in_scope(F.col("path"), [], ["src/m0", "d4"], []).alias("second"))


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN 2 * p_size + 1 ELSE 0 END AS lines, (CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN 2 * p_size + 1 ELSE 0 END) = 0 OR (CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN 2 * p_size + 1 ELSE 0 END) BETWEEN 7 AND 40 AS fits,
p_partkey % 3 = 0 AS verified, p_partkey % 7 = 6 OR p_brand IN ('Brand#11', 'Brand#12') AS in_files FROM part""")
def triage_function_selection(spark, d):
    p = t.table(spark, d, "part", "p_partkey", "p_size", "p_brand")
    n, size = F.col("p_partkey"), F.col("p_size")
    lines = triage.line_count(F.when(size % 3 == 0, size).otherwise(0), first=F.when(size % 3 == 1, size).otherwise(0), last=F.when(size % 3 == 1, size * 3).otherwise(0))
    name, path = (n % 3).cast("string"), F.when(n % 7 != 6, F.col("p_brand"))
    return p.select(n.alias("k"), lines.alias("lines"), triage.fit_length(lines, 7, 40).alias("fits"), triage.selected(name, path, ["0"], [], F.lit(True)).alias("verified"), triage.selected(name, path, [], ["Brand#11", "Brand#12"], F.lit(True)).alias("in_files"))


@query(f"{I} SELECT doc_id FROM issues WHERE severity = 'high' AND category = 'en'")
def triage_equality_filter(spark, d):
    return t.issues(spark, d).where(triage.matching(severity="high", category="en")).select("doc_id")


FOLDERS = "WITH f AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'a' || (p_partkey % 6) WHEN 1 THEN 'a' || (p_partkey % 6) || '/b' || (p_partkey % 5) ELSE 'a' || (p_partkey % 7) || '/b' || (p_partkey % 5) || '/c' || (p_partkey % 4) END AS path FROM part)"


@query(FOLDERS + " SELECT path FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE starts_with(f.path, g.path || '/'))")
def triage_highest_folders(spark, d):
    k = F.col("p_partkey")
    part = lambda c, n: F.concat(F.lit(c), (k % n).cast("string"))
    path = F.when(k % 3 == 0, part("a", 6)).when(k % 3 == 1, F.concat_ws("/", part("a", 6), part("b", 5))).otherwise(F.concat_ws("/", part("a", 7), part("b", 5), part("c", 4)))
    return triage.highest_folders(t.table(spark, d, "part", "p_partkey").select(path.alias("path")).distinct())


@query("""WITH f AS (SELECT 'a' || (p_partkey % 6) AS a, 'a' || (p_partkey % 6) || '/b' || (p_partkey % 15) AS b, p_partkey % 6 = 2 OR p_partkey % 15 IN (1, 4) AS x FROM part), u AS (SELECT a AS path, x FROM f UNION ALL SELECT b, x FROM f), g AS (SELECT path FROM u GROUP BY 1 HAVING bool_and(x))
SELECT path FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE starts_with(g.path, h.path || '/'))""")
def triage_excluded_roll_up(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.lit("a"), (k % 6).cast("string"), F.lit("/b"), (k % 15).cast("string"), F.lit("/f"), k.cast("string"))
    return triage.rolled_up(t.table(spark, d, "part", "p_partkey").select(path.alias("path"), ((k % 6 == 2) | (k % 15).isin(1, 4)).alias("excluded")))


@query(f"""{I}, s AS (SELECT doc_id, source, lower(category || '::' || severity || '::' || length(body) || '::' || body) AS sig FROM issues)
SELECT count(*) AS new, count(*) FILTER (WHERE false) AS unknown FROM s WHERE source IN ('src0', 'src1') AND sig NOT IN (SELECT sig FROM s WHERE source NOT IN ('src0', 'src1'))""")
def triage_new_findings(spark, d):
    """Findings of one run whose signature the other does not have, counted."""
    i = t.issues(spark, d).withColumn("sig", triage.signature(F.col("category"), F.col("severity"), F.length("body").cast("string"), F.col("body")))
    mine, base = F.col("source").isin("src0", "src1"), ~F.col("source").isin("src0", "src1")
    new = i.where(mine).join(i.where(base).select("sig"), "sig", "left_anti")
    return new.agg(F.count("*").alias("new"), F.count_if(F.col("sig").isNull()).alias("unknown"))


@query("""WITH p AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'a/b' || (p_partkey % 4) || '/f.c' WHEN 1 THEN 'f' || (p_partkey % 4) || '.c' WHEN 2 THEN 'common' WHEN 3 THEN '' WHEN 4 THEN '/f.c' ELSE '.git' END AS path, p_partkey % 6 AS r, p_partkey % 4 AS m FROM part)
SELECT CASE r WHEN 0 THEN 'a/b' || m WHEN 1 THEN 'root' WHEN 2 THEN 'common' WHEN 3 THEN 'uncategorized' WHEN 4 THEN 'root' ELSE '.git' END AS directory, count(*) AS n FROM p GROUP BY 1""")
def triage_directory_names(spark, d):
    k = F.col("p_partkey")
    m = (k % 4).cast("string")
    path = F.when(k % 6 == 0, F.concat(F.lit("a/b"), m, F.lit("/f.c"))).when(k % 6 == 1, F.concat(F.lit("f"), m, F.lit(".c"))).when(k % 6 == 2, "common").when(k % 6 == 3, "").when(k % 6 == 4, "/f.c").otherwise(".git")
    return t.table(spark, d, "part", "p_partkey").groupBy(triage.directory_of(path).alias("directory")).agg(F.count("*").alias("n"))


FILES = "f AS (SELECT DISTINCT 'src/m' || (s_suppkey % 3) || '/f' || (s_suppkey % 7) || '.c' AS path, 'src/m' || (s_suppkey % 3) AS node, 'f' || (s_suppkey % 7) || '.c' AS name FROM supplier WHERE s_suppkey % 7 < 5 OR s_suppkey % 3 = 0)"
WANTED = "w AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'src/m' || (p_partkey % 4) || '/f' || (p_partkey % 7) || '.c' WHEN 1 THEN 'f' || (p_partkey % 9) || '.c' ELSE 'old/f' || (p_partkey % 8) || '.c' END AS path FROM part)"
ASSIGNED = f"WITH {FILES}, {WANTED}, n AS (SELECT name, min(node) AS node FROM (SELECT DISTINCT name, node FROM f) GROUP BY 1 HAVING count(*) = 1), a AS (SELECT k, w.path, coalesce(f.node, n.node) AS node FROM w LEFT JOIN f ON f.path = w.path LEFT JOIN n ON n.name = string_split(w.path, '/')[-1])"


def assigned(spark, d):
    s, k = F.col("s_suppkey"), F.col("p_partkey")
    p = lambda c, n: (c % n).cast("string")
    files = t.table(spark, d, "supplier", "s_suppkey").where("s_suppkey % 7 < 5 OR s_suppkey % 3 = 0").select(F.concat(F.lit("src/m"), p(s, 3), F.lit("/f"), p(s, 7), F.lit(".c")).alias("path")).distinct()
    path = F.when(k % 3 == 0, F.concat(F.lit("src/m"), p(k, 4), F.lit("/f"), p(k, 7), F.lit(".c"))).when(k % 3 == 1, F.concat(F.lit("f"), p(k, 9), F.lit(".c"))).otherwise(F.concat(F.lit("old/f"), p(k, 8), F.lit(".c")))
    return triage.assigned(t.table(spark, d, "part", "p_partkey").select(k.alias("k"), path.alias("path")), files)


@query(ASSIGNED + " SELECT k, path, node, coalesce(node || '/' || string_split(path, '/')[-1], 'Unknown') AS rewritten, coalesce(node, 'src') AS tree_node FROM a")
def triage_assigned_directories(spark, d):
    """By path, else by a name that only one folder has; the rest goes to the root of the tree."""
    a = assigned(spark, d)
    return a.select("k", "path", "node", F.coalesce(F.concat(F.col("node"), F.lit("/"), fn.base_name(F.col("path"))), F.lit("Unknown")).alias("rewritten"), F.coalesce("node", F.lit("src")).alias("tree_node"))


@query(ASSIGNED + " SELECT count(*) AS issues, count(node) AS assigned, count(*) FILTER (WHERE node IS NULL) AS unassigned, count(node) * 1.0::DOUBLE / count(*) AS rate, count(DISTINCT node) AS folders, (SELECT count(*) FROM f) AS files FROM a")
def triage_assignment_statistics(spark, d):
    s = F.col("s_suppkey")
    files = t.table(spark, d, "supplier", "s_suppkey").where("s_suppkey % 7 < 5 OR s_suppkey % 3 = 0").select(F.concat((s % 3).cast("string"), F.lit("/"), (s % 7).cast("string")).alias("path")).distinct().agg(F.count("*").alias("files"))
    return assigned(spark, d).agg(F.count("*").alias("issues"), F.count("node").alias("assigned"), F.count_if(F.col("node").isNull()).alias("unassigned"), F.avg(F.col("node").isNotNull().cast("double")).alias("rate"), F.countDistinct("node").alias("folders")).crossJoin(F.broadcast(files))


@query(f"""{I}, u AS (SELECT source AS prefix, * FROM issues UNION ALL SELECT directory AS prefix, * FROM issues)
SELECT prefix, count(*) AS issues, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
count(DISTINCT file_path) AS files, count(DISTINCT CASE WHEN prefix = source THEN directory END) AS folders FROM u GROUP BY 1""")
def triage_folder_summary(spark, d):
    return triage.folder_summary(t.issues(spark, d))


@query(f"{I} SELECT severity, count(*) AS n, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) AS place FROM issues GROUP BY 1")
def triage_ranked_severities(spark, d):
    from pyspark.sql import Window

    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 3).otherwise(4)
    return t.issues(spark, d).groupBy("severity").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(rank)))  # a row per severity


@query(f"{I} SELECT category, directory, count(*) AS issues, count(*) FILTER (WHERE severity IN ('critical', 'high')) AS urgent, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM issues GROUP BY 1, 2")
def triage_grouped_by_function(spark, d):
    i = t.issues(spark, d).groupBy("category", "directory").agg(F.count("*").alias("issues"), F.count_if(F.col("severity").isin("critical", "high")).alias("urgent"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return i.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("""WITH RECURSIVE r AS (SELECT doc_id, lang, length(text) // 4 + 50 AS c, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents),
b AS (SELECT lang, doc_id, n, 0::BIGINT AS batch, 1 AS k, c AS total FROM r WHERE n = 1 UNION ALL
SELECT r.lang, r.doc_id, r.n, b.batch + CASE WHEN k >= 8 OR total + c > 5000 THEN 1 ELSE 0 END, CASE WHEN k >= 8 OR total + c > 5000 THEN 1 ELSE k + 1 END, CASE WHEN k >= 8 OR total + c > 5000 THEN c ELSE total + c END FROM b JOIN r ON r.lang = b.lang AND r.n = b.n + 1)
SELECT lang, doc_id, batch FROM b""")
def triage_token_batches(spark, d):
    """Documents of each language in batches of at most eight, and 5,000 estimated tokens where one fits."""
    docs = t.table(spark, d, "documents", "doc_id", "lang", "text").select("doc_id", "lang", (fn.token_estimate(F.col("text")) + 50).alias("cost"))
    return triage.batched(docs, "lang", "doc_id", "cost", 5000, 8).select("lang", "doc_id", "batch")


@query(f"{I} SELECT directory, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY doc_id) AS k FROM issues) WHERE k <= 3 ORDER BY directory, k LIMIT 12")
def triage_capped_groups(spark, d):
    return triage.capped(t.issues(spark, d).select("directory", "doc_id"), "directory", ["doc_id"], 3, 12)


@query(f"{I} SELECT doc_id, severity, source || '/' || category AS file_path, coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'fn' || (doc_id % 9) END, ''), 'unknown') AS function_name, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 300 END AS line_number FROM issues")
def triage_normalised_fields(spark, d):
    """Records with other names for their fields, empty strings and numbers as text."""
    i = t.issues(spark, d)
    k = F.col("doc_id")
    raw = i.select("doc_id", "severity", F.lit("").alias("file_path"), F.concat_ws("/", "source", "category").alias("file"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("fn"), (k % 9).cast("string"))).alias("function"), F.when(k % 5 == 0, "about here").otherwise((k % 300).cast("string")).alias("line"))
    return raw.select("doc_id", "severity", findings.first_filled("file_path", "file").alias("file_path"), F.coalesce(findings.first_filled("function"), F.lit("unknown")).alias("function_name"), F.expr("try_cast(line AS bigint)").alias("line_number"))


@query(f"{I} SELECT doc_id, severity, category, 'a  b' AS title FROM issues")
def source_issue_dump(spark, d):
    """Findings written as blocks of text and read back."""
    i = t.issues(spark, d).select("doc_id", "severity", "category")
    block = F.concat(F.lit("Title: a  b\nSeverity: "), "severity", F.lit("\nCategory: "), "category", F.lit("\nFile: f"), F.col("doc_id").cast("string"), F.lit("\nImpact: none\nof it\n"))
    dump = i.repartition(4).groupBy(F.spark_partition_id().alias("file")).agg(F.array_join(F.collect_list(block), "======================\n").alias("body"))
    got = reports.issue_blocks(dump, "body")
    return got.select(F.substr("file_path", F.lit(2)).cast("long").alias("doc_id"), "severity", "category", "title")


@query(f"{I} SELECT doc_id, severity, 'x {{ y' AS note FROM issues")
def source_html_report(spark, d):
    """Findings embedded as JSON in report pages, found by balanced braces."""
    one = F.to_json(F.struct("doc_id", "severity", F.lit("x { y").alias("note")))
    pages = t.issues(spark, d).groupBy("directory").agg(F.concat(F.lit("<html><script>var data = {\"issues\": ["), F.array_join(F.collect_list(one), ","), F.lit("]};</script></html>")).alias("html"))
    return reports.embedded_issues(pages, "html", "doc_id long, severity string, note string")


@query(f"{I} SELECT doc_id, severity, category FROM issues")
def source_markdown_issues(spark, d):
    text = F.concat(F.lit("# Finding "), F.col("doc_id").cast("string"), F.lit("\n\n- **Severity**: "), "severity", F.lit("\n- **Category**: "), "category", F.lit("\n\n## Description\nsome\n"))
    got = reports.markdown_issues(t.issues(spark, d).select(text.alias("body")), "body")
    return got.select(F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("doc_id"), "severity", "category")


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{\"a\":[1,2]}' WHEN 1 THEN '[{\"b\":\"}\"}]' WHEN 2 THEN '{\"c\":1}' ELSE 'plain' END AS json, CASE turn % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS objects FROM conversations")
def source_json_in_answers(spark, d):
    """The largest balanced JSON value in answers with other text around it, else a fenced block, else the text."""
    k = F.col("turn") % 4
    body = F.when(k == 0, 'so: {"a":[1,2]} done').when(k == 1, '```json\n[{"b":"}"}]\n```').when(k == 2, 'x {} y {"c":1} }').otherwise("  plain ")
    c = t.table(spark, d, "conversations", "conv_id", "turn").withColumn("body", body)
    return c.select("conv_id", "turn", reports.cleaned_json("body").alias("json"), F.size(reports.json_objects("body")).alias("objects"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'read_file' || (turn % 3) || ',list' ELSE '' END AS tools FROM conversations")
def source_tool_requests(spark, d):
    k = F.col("turn")
    call = F.concat(F.lit('first {"tool": "read_file'), (k % 3).cast("string"), F.lit('", "path": "a"} then {"tool": "list"} and {"tool": "list"}'))
    c = t.table(spark, d, "conversations", "conv_id", "turn").withColumn("body", F.when(k % 2 == 0, call).otherwise("nothing {x}"))
    return c.select("conv_id", "turn", F.array_join(reports.tool_requests("body"), ",").alias("tools"))


@query("SELECT conv_id, turn, coalesce(contains(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), left(text, 20)), false) AS used FROM conversations")
def triage_context_used(spark, d):
    """Whether the next turn quotes the beginning of this one."""
    from pyspark.sql import Window

    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.table(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.coalesce(F.contains(after, F.left("text", F.lit(20))), F.lit(False)).alias("used"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT doc_id, n FROM l WHERE contains(line, 'License') OR contains(line, 'token ='))
SELECT DISTINCT l.doc_id, l.n, md5(line) AS line FROM l JOIN m ON l.doc_id = m.doc_id AND abs(l.n - m.n) <= 2""")
def search_lines_around(spark, d):
    """Matching lines with two lines on both sides."""
    docs = t.table(spark, d, "documents", "doc_id", "text")
    got = search.around(docs, "doc_id", "text", F.contains("line", F.lit("License")) | F.contains("line", F.lit("token =")), 2)
    return got.select("doc_id", (F.col("n") + 1).alias("n"), F.md5("line").alias("line"))
