"""Queries that write a format and read it back, and readers of files of each format."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import traces
from ..plans import scratch
from ..plans import stand_ins as t
from ..registry import query
from ..sources import files, reports, stores, text_sinks


def _folder(spark, name: str) -> str:
    scratch.checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("""SELECT md5(text) AS issue, CASE WHEN doc_id % 3 = 0 THEN lang || '.c' ELSE source || '.c' END AS file_path, 'f' || (doc_id // 20) AS function_name, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 1000)::INT END AS line_number FROM documents""")
def sink_result_files(spark, d):
    """Results, gathered by file, function and checksum, written as JSON and read back; a wrapper fills what a result lacks."""
    docs = t.table(spark, d, "documents", "doc_id", "text", "lang", "source")
    own = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit(".c"))).otherwise("")
    line = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 1000).cast("string")).otherwise("none")
    run = F.floor(F.col("doc_id") / 20).cast("string")
    inner = F.struct(F.md5("text").alias("issue"), own.alias("file_path"), line.alias("line_number"))
    each = docs.select(F.concat("source", F.lit(".c")).alias("file_path"), F.concat(F.lit("f"), run).alias("function"), F.md5(run).alias("checksum"), inner.alias("r"))
    path = _folder(spark, "results")
    wrapped = each.groupBy("file_path", "function", "checksum").agg(F.collect_list("r").alias("results"))  # 20 documents at most
    wrapped.write.json(path)
    return files.results(spark, path, lines=True).select("issue", "file_path", "function_name", "line_number")


COSTS = "SELECT p_brand AS name, count(*) AS frames, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS cost FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"


@query(f"WITH c AS ({COSTS}) SELECT unnest(['json', 'csv', 'text']) AS format, name, frames, cost, row_number() OVER (ORDER BY cost DESC, name) AS place FROM c")
def sink_costs(spark, d):
    """Aggregated costs, highest first, in three formats, read back with the place of each."""
    item, part = t.table(spark, d, "lineitem", "l_partkey", "l_extendedprice"), t.table(spark, d, "part", "p_partkey", "p_brand")
    costs = item.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("frames"), F.sum(F.floor("l_extendedprice").cast("long")).alias("cost"))
    path, schema = _folder(spark, "costs"), "name string, frames long, cost long"
    text_sinks.write_costs(costs, path, F.desc("cost"))
    text = F.split("value", "\t")
    read = {
        "json": spark.read.schema(schema).json(f"{path}/json"), "csv": spark.read.schema(schema).option("header", True).csv(f"{path}/csv"),
        "text": spark.read.text(f"{path}/text").select(text[0].alias("name"), text[1].cast("long").alias("frames"), text[2].cast("long").alias("cost")),
    }
    out = None
    for name, df in read.items():
        placed = scratch.ranked(df, [F.desc("cost"), "name"], "place").select(F.lit(name).alias("format"), "name", "frames", "cost", (F.col("place") + 1).alias("place"))
        out = placed if out is None else out.unionByName(placed)
    return out


@query("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') AS cell FROM documents")
def sink_html_rows(spark, d):
    """Whole texts as cells of an HTML table, escaped, a line each."""
    path = _folder(spark, "html")
    stores.write_html(t.table(spark, d, "documents", "doc_id", "text"), path, "doc_id", "text")
    row = r"^<tr><td>(\d+)</td><td>(.*)</td></tr>$"
    return spark.read.text(path, lineSep="\n").select(F.regexp_extract("value", row, 1).cast("long").alias("doc_id"), F.regexp_extract("value", row, 2).alias("cell"))


@query("""WITH i AS (SELECT l_orderkey AS root, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS k FROM lineitem)
SELECT root, 'o' || root || chr(10) || string_agg('  s' || l_suppkey || CASE WHEN k % 2 = 0 THEN chr(10) || '    even' ELSE '' END, chr(10) ORDER BY k) AS text FROM i GROUP BY root""")
def sink_call_trees(spark, d):
    """A tree for each order, as indented text."""
    item = t.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey")
    listed = item.groupBy(F.col("l_orderkey").alias("root")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("l"))
    items = listed.select("root", F.posexplode("l").alias("k", "x")).select("root", "k", "x.l_suppkey")
    nodes = listed.select("root", F.lit(0).alias("depth"), F.lit(0).alias("order"), F.concat(F.lit("o"), "root").alias("name"))
    nodes = nodes.unionByName(items.select("root", F.lit(1).alias("depth"), (2 * F.col("k") + 1).alias("order"), F.concat(F.lit("s"), "l_suppkey").alias("name")))
    nodes = nodes.unionByName(items.where("k % 2 = 1").select("root", F.lit(2).alias("depth"), (2 * F.col("k") + 2).alias("order"), F.lit("even").alias("name")))
    path = _folder(spark, "trees")
    text_sinks.tree_text(nodes).write.json(path)
    return spark.read.schema("root long, text string").json(path)


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last, max(md5(text)) AS text FROM conversations GROUP BY 1")
def sink_conversations(spark, d):
    """A log of conversations, appended to by role."""
    path, turns = _folder(spark, "log"), t.table(spark, d, "conversations")
    for role in (F.col("role") == "user", F.coalesce(F.col("role") != "user", F.lit(True))):
        text_sinks.write_conversations(turns.where(role), path)
    return spark.read.parquet(path).groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last"), F.max(F.md5("text")).alias("text"))


@query("SELECT md5(p_name || p_partkey) AS checksum, p_name || ', \"' || p_type || '\"' AS issue_title, p_brand AS issue_description FROM part WHERE p_partkey % 5 <> 2")
def source_known_findings(spark, d):
    """A list of known findings with comments, blank lines and rows without a checksum, written and read."""
    p = t.table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand")
    title = F.concat(F.lit('"'), "p_name", F.lit(', ""'), "p_type", F.lit('"""'))
    row = F.concat_ws(",", F.when(F.col("p_partkey") % 5 == 2, " ").otherwise(F.md5(F.concat("p_name", F.col("p_partkey").cast("string")))), title, "p_brand")
    lines = F.concat(F.lit("checksum,issue_title,issue_description\n# reviewed\n"), F.array_join(F.collect_list(row), "\n\n"), F.lit("\n# end\n"))
    path = _folder(spark, "known")
    files_ = p.groupBy(F.floor(F.col("p_partkey") / 200).alias("file")).agg(lines.alias("value"))  # 200 rows a file
    files_.write.partitionBy("file").option("lineSep", "\n").text(path)
    return stores.known_findings(spark, f"{path}/*")


@query("""WITH i AS (SELECT l_orderkey, l_suppkey, l_partkey, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) - 1 AS k FROM lineitem),
o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey // 200 ORDER BY l_orderkey) - 1 AS trace FROM (SELECT DISTINCT l_orderkey FROM i))
SELECT 'file=' || (l_orderkey // 200) AS file, trace, k AS pos, q AS cost, 'lib' || (l_suppkey % 9) AS library, 'run s' || l_suppkey AS function, CASE WHEN l_partkey % 2 = 0 THEN 'p' || l_partkey || '.c' ELSE '' END AS source FROM i JOIN o USING (l_orderkey)""")
def source_text_traces(spark, d):
    """Traces of orders as text, 200 orders a file at most, each frame with the number of its trace in the file."""
    item = t.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity").withColumn("q", F.col("l_quantity").cast("long"))
    by_order = item.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "q"))).alias("l"))
    source = lambda x: F.when(x["l_partkey"] % 2 == 0, F.concat(F.lit(" (p"), x["l_partkey"], F.lit(".c)"))).otherwise("")
    line = lambda x: F.concat(F.lit("  1.5% ("), x["q"], F.lit(") lib"), x["l_suppkey"] % 9, F.lit(" run s"), x["l_suppkey"], source(x))
    body = F.array_join(F.transform("l", line), "\n")
    texts = by_order.select("l_orderkey", body.alias("body")).groupBy(F.floor(F.col("l_orderkey") / 200).alias("file")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "body"))).alias("t"))
    path = _folder(spark, "traces")
    texts.select("file", F.array_join(F.transform("t", lambda x: x["body"]), "\n=====\n").alias("value")).write.partitionBy("file").text(path)
    got = files.traces(spark, f"{path}/*")
    return got.select(F.regexp_extract("file", "(file=[0-9]+)", 1).alias("file"), F.col("trace").cast("long").alias("trace"), _position().alias("pos"), "cost", "library", "function", "source")


def _position():
    from pyspark.sql import Window

    return (F.row_number().over(Window.partitionBy("file", "trace").orderBy("pos")) - 1).cast("long")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 5 THEN NULL ELSE md5(text) END AS issue, CASE WHEN doc_id % 7 = 5 THEN NULL ELSE (doc_id % 100)::INT END AS line FROM documents")
def source_repaired_json(spark, d):
    """Answers that hold JSON: whole, in a fence, with talk around it, and cut off for good."""
    docs = t.table(spark, d, "documents", "doc_id", "text")
    json = F.to_json(F.struct(F.md5("text").alias("issue"), (F.col("doc_id") % 100).cast("int").alias("line")))
    k = F.col("doc_id") % 7
    body = F.when(k == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(k == 3, F.concat(F.lit("Here {it} is: "), json, F.lit(" as asked."))).when(k == 5, F.left(json, F.length(json) - 1)).otherwise(json)
    path = _folder(spark, "answers")
    docs.select("doc_id", body.alias("body")).write.json(path)
    read = spark.read.schema("doc_id long, body string").json(path)
    return reports.repaired(read, "body", "issue string, line int").select("doc_id", "doc.issue", "doc.line")


@query("""SELECT 'r' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.json' WHEN 1 THEN '.htm' WHEN 2 THEN '.md' WHEN 3 THEN '.txt' ELSE '' END AS path, CASE doc_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'html' WHEN 2 THEN 'markdown' WHEN 3 THEN 'text' ELSE 'json' END AS format,
md5(text) AS title, CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'low' END AS severity FROM documents""")
def source_report_formats(spark, d):
    """Reports of all formats, each read by the first reader that can, told by its ending or by how it begins."""
    docs = t.table(spark, d, "documents", "doc_id", "text")
    title, severity = F.md5("text"), F.when(F.col("doc_id") % 2 == 0, "high").otherwise("low")
    k, json = F.col("doc_id") % 5, F.concat(F.lit("["), F.to_json(F.struct(title.alias("title"), severity.alias("severity"))), F.lit("]"))
    body = F.when(k.isin(0, 4), json).when(k == 1, F.concat(F.lit("<html><script>const d = {\"issues\": "), json, F.lit("}</script></html>")))
    body = body.when(k == 2, F.concat(F.lit("# "), title, F.lit("\n\n**Severity**: "), severity, F.lit("\n"))).otherwise(F.concat(F.lit("Title: "), title, F.lit("\nSeverity: "), severity, F.lit("\n")))
    ending = F.when(k == 0, ".json").when(k == 1, ".htm").when(k == 2, ".md").when(k == 3, ".txt").otherwise("")
    return reports.parsed(docs.select(F.concat(F.lit("r"), "doc_id", ending).alias("path"), body.alias("body")))


@query("SELECT l_orderkey, l_linenumber, 'lib' || (l_suppkey % 9) AS owner FROM lineitem WHERE l_suppkey % 9 IN (2, 4)")
def trace_frames_of_owners(spark, d):
    """Frames of chosen libraries; an empty choice keeps all."""
    owner = F.concat(F.lit("lib"), F.col("l_suppkey") % 9)
    rows = t.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").select("l_orderkey", "l_linenumber", owner.alias("owner"))
    return rows.where(traces.of_interest(F.col("owner"), ["lib2", "lib4"])).where(traces.of_interest(F.col("owner"), []))


@query("SELECT vec_id, round((0.5 * (vec_id % 10) / 9.0 + 0.25 * (vec_id % 7) / 6.0 + 0.25 * (label % 5) / 4.0)::DOUBLE, 9) AS score FROM embeddings")
def score_by_given_weights(spark, d):
    """Weights that do not sum to one are set right before they weigh the parts of a score."""
    w = scores.weights({"file": 1.0, "function": 0.5, "semantic": 0.5})
    e = t.table(spark, d, "embeddings", "vec_id", "label")
    score = (F.col("vec_id") % 10) / 9.0 * w["file"] + (F.col("vec_id") % 7) / 6.0 * w["function"] + (F.col("label") % 5) / 4.0 * w["semantic"]
    return e.select("vec_id", F.round(score, 9).alias("score"))
