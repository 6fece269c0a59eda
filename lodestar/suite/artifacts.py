"""Queries on stored files and tables: they write what they read, from the given tables, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import writeback
from ..plans import scratch
from ..plans import stand_ins as t
from ..registry import query
from ..sources import file_index, pages, result_dirs


def _folder(spark, name: str) -> str:
    scratch.checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# result files: for each source and run of 400 documents a file, cut short where one of them is toxic

ITEMS_SQL = """i AS (SELECT d.*, l.quality, coalesce(l.toxic, 0) AS toxic, doc_id // 400 AS chunk FROM documents d LEFT JOIN labels l USING (doc_id)),
f AS (SELECT source, chunk, count(*) AS n, max(toxic) = 1 AS broken, min(lang) = max(lang) AS same, arg_min(lang, doc_id) AS lang FROM i GROUP BY 1, 2)"""


def _write_files(spark, d) -> str:
    """Lists of issues, a number among them where all are of one language, or the object alone where there is only one."""
    path = _folder(spark, "result-files")
    docs = t.table(spark, d, "documents").join(t.table(spark, d, "labels"), "doc_id", "left")
    severity = F.when(F.col("quality") == 1, "Low").when(F.col("quality") == 0, "High")
    fields = [F.col("doc_id"), F.left(F.md5("text"), F.lit(8)).alias("issue"), severity.alias("severity"), F.concat("lang", F.lit("/x.c")).alias("file_path"), F.when(F.col("lang") == "fr", "[]").alias("original_callstack")]
    each = docs.select("source", F.floor(F.col("doc_id") / 400).alias("chunk"), "doc_id", "lang", F.coalesce("toxic", F.lit(0)).alias("toxic"), F.to_json(F.struct(*fields)).alias("json"))
    files = each.groupBy("source", "chunk").agg(F.array_sort(F.collect_list(F.struct("doc_id", "json"))).alias("l"), F.max("toxic").alias("bad"), (F.min("lang") == F.max("lang")).alias("same"))  # 400 at most
    objects = F.transform("l", lambda x: x["json"])
    list_ = F.concat(F.lit("["), F.array_join(objects, ",\n"), F.when(F.col("same"), F.lit(",7]")).otherwise("]"))
    whole = F.when(F.size("l") == 1, F.get(objects, F.lit(0))).otherwise(list_)
    text = F.when(F.col("bad") == 1, F.left(whole, F.length(whole) - 1)).otherwise(whole)
    rows = files.select(F.concat("source", F.lit("_results")).alias("dir"), F.concat(F.lit("part"), F.col("chunk").cast("string"), F.lit("_analysis")).alias("name"), text.alias("value"))
    rows.write.partitionBy("dir", "name").text(path)
    return path


@query(f"""WITH {ITEMS_SQL}, s AS (SELECT source, count(*) AS files, count(*) FILTER (WHERE NOT broken) AS valid, count(*) FILTER (WHERE broken) AS invalid,
  sum(CASE WHEN broken THEN 0 WHEN n > 1 AND same THEN n + 1 ELSE n END)::BIGINT AS issues, count(*) FILTER (WHERE NOT broken AND lang = 'fr') AS calls FROM f GROUP BY 1),
g AS (SELECT i.* FROM i JOIN f USING (source, chunk) WHERE NOT broken)
SELECT source || '_results' AS folder, what, value, n FROM (
  SELECT source, unnest(['files', 'valid', 'invalid', 'issues', 'with_callstack']) AS what, '' AS value, unnest([files, valid, invalid, issues, calls]) AS n FROM s
  UNION ALL SELECT source, 'severity', CASE quality WHEN 1 THEN 'low' WHEN 0 THEN 'high' ELSE 'unknown' END, count(*) FROM g GROUP BY ALL
  UNION ALL SELECT source, 'file_path', lang || '/x.c', count(*) FROM g GROUP BY ALL
  UNION ALL SELECT source, 'function', 'unknown', count(*) FROM g GROUP BY ALL)""")
def files_folder_statistics(spark, d):
    got = result_dirs.statistics(spark, _write_files(spark, d))
    folder = F.regexp_extract("folder", "dir=([^/]*)", 1)
    return got.groupBy(folder.alias("folder"), "what", "value").agg(F.sum("n").alias("n"))


@query(f"""WITH {ITEMS_SQL} SELECT count(*) AS files, count(*) FILTER (WHERE NOT broken) AS processed, count(*) FILTER (WHERE broken OR n > 1 AND same) AS with_errors, sum(n) FILTER (WHERE NOT broken)::BIGINT AS issues,
(SELECT sum(doc_id) FROM i JOIN f USING (source, chunk) WHERE NOT broken)::BIGINT AS ids FROM f""")
def files_scan_counts(spark, d):
    """Issues of a folder tree, and in the same pass what was read and what was broken."""
    watch = Observation("files")
    found = result_dirs.issues(spark, _write_files(spark, d), watch=watch)
    total = found.agg(F.count("*").alias("issues"), F.sum(F.try_variant_get("item", "$.doc_id", "long")).alias("ids")).collect()  # one row; the counts come with it
    return spark.createDataFrame([(watch.get["files"], watch.get["processed"], watch.get["with_errors"], *total[0])], "files long, processed long, with_errors long, issues long, ids long")


@query(f"WITH {ITEMS_SQL} SELECT doc_id, quality = 0 AS high, n FROM i JOIN f USING (source, chunk) WHERE NOT broken")
def files_issues(spark, d):
    """Every issue of the whole files, with how many its file has."""
    read = result_dirs.files(spark, _write_files(spark, d))
    objects = F.filter("items", result_dirs.is_object)
    each = read.select(F.size(objects).cast("long").alias("n"), F.explode(objects).alias("item"))
    return each.select(F.try_variant_get("item", "$.doc_id", "long").alias("doc_id"), (result_dirs.text("item", "severity") == "High").alias("high"), "n")


# write-back

STORED_SQL = """s AS (SELECT source AS part, lang || (doc_id // 20) AS function, left(md5(source || lang || (doc_id // 20)), CASE WHEN doc_id // 20 % 9 = 4 THEN 6 ELSE 12 END) AS checksum, doc_id, md5(text) AS issue FROM documents),
v AS (SELECT s.*, length(checksum) >= 8 AND NOT EXISTS (SELECT 1 FROM s o LEFT JOIN labels l USING (doc_id) WHERE left(o.checksum, 8) = left(s.checksum, 8) AND o.issue = s.issue AND length(o.checksum) >= 8 AND (o.part < 'src2' OR l.quality IS NULL OR l.quality = 1)) AS gone FROM s)"""


def _stored(spark, d):
    docs = t.table(spark, d, "documents", "doc_id", "text", "lang", "source")
    run = F.floor(F.col("doc_id") / 20).cast("string")
    long_ = F.md5(F.concat("source", "lang", run))
    checksum = F.when(F.floor(F.col("doc_id") / 20) % 9 == 4, F.left(long_, F.lit(6))).otherwise(F.left(long_, F.lit(12)))
    return docs.select("doc_id", F.col("source").alias("part"), F.concat("lang", run).alias("function"), F.concat("lang", F.lit(".c")).alias("file_path"), checksum.alias("checksum"), F.md5("text").alias("issue"))


@query(f"""WITH {STORED_SQL} SELECT part, count(DISTINCT (function, checksum)) AS rows, count(*) FILTER (WHERE NOT gone) AS kept, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE gone) = 0 AS untouched FROM v GROUP BY 1""")
def files_write_back(spark, d):
    """Stored issues that did not survive are archived; only the partitions that lose some get new files."""
    path, archive = _folder(spark, "stored"), _folder(spark, "archive")
    issues = _stored(spark, d)
    stored = issues.groupBy("part", "function", "file_path", "checksum").agg(F.collect_list(F.struct(F.concat(F.lit(" "), "issue").alias("issue"), "doc_id")).alias("results"))
    stored.repartition("part").write.partitionBy("part").parquet(path)
    files = lambda: spark.read.parquet(path).groupBy("part").agg(F.sort_array(F.collect_set("_metadata.file_path")).alias("files"), F.count("*").alias("rows"), F.sum(F.size("results")).alias("kept"))
    before = files().select("part", F.col("files").alias("was")).checkpoint()
    quality = t.table(spark, d, "labels", "doc_id", "quality")
    surviving = issues.join(quality, "doc_id", "left").where("part < 'src2' OR quality IS NULL OR quality = 1").select("checksum", "issue")
    writeback.write_back(spark, path, surviving, archive)
    removed = spark.read.parquet(archive).groupBy("part").agg(F.count("*").alias("removed"))
    return files().join(before, "part").join(removed, "part", "left").select("part", "rows", "kept", F.coalesce("removed", F.lit(0)).alias("removed"), (F.col("files") == F.col("was")).alias("untouched"))


@query(f"WITH {STORED_SQL} SELECT DISTINCT function, checksum, issue FROM v WHERE gone")
def files_dropped_issues(spark, d):
    """The archive of a write-back that was run twice and one of another level, below one folder."""
    path, archive = _folder(spark, "stored"), _folder(spark, "archive")
    issues = _stored(spark, d)
    issues.groupBy("part", "function", "file_path", "checksum").agg(F.collect_list(F.struct("issue", "doc_id")).alias("results")).write.partitionBy("part").parquet(path)
    quality = t.table(spark, d, "labels", "doc_id", "quality")
    surviving = issues.join(quality, "doc_id", "left").where("part < 'src2' OR quality IS NULL OR quality = 1").select("checksum", "issue")
    writeback.write_back(spark, path, surviving, f"{archive}/final")
    writeback.write_back(spark, path, surviving, f"{archive}/final")  # nothing is left to remove
    spark.read.parquet(f"{archive}/final").write.parquet(f"{archive}/again/copies")
    found = writeback.archived(spark, archive)
    return found.select("function", "checksum", F.col("issue.issue").alias("issue"))


# names and files

@query(r"""WITH f AS (SELECT DISTINCT replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.', '/') || '/' || (page_id % 3) || '/f' || (page_id % 20) || '.c' AS path, (page_id * 3 + 1) % 20 AS k FROM pages),
n AS (SELECT DISTINCT path, string_split(path, '/') AS p, lower(string_split(path, '/')[-1]) AS b FROM f), w AS (SELECT DISTINCT path AS hint, 'F' || k || '.c' AS name FROM f),
d AS (SELECT hint, name, path, len(p) - len(list_filter(range(1, least(len(p), len(string_split(hint, '/')))), lambda i: p[1:i] = string_split(hint, '/')[1:i])) AS far FROM w JOIN n ON b = lower(name))
SELECT w.hint, w.name, arg_min(path, (far, path)) AS path, min(far)::INT AS far FROM w LEFT JOIN d USING (hint, name) GROUP BY 1, 2""")
def files_nearest_by_name(spark, d):
    """Names that many folders have, looked up from beside each file; letters in any case."""
    host = F.replace(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.lit("."), F.lit("/"))
    path = F.concat(host, F.lit("/"), F.col("page_id") % 3, F.lit("/f"), F.col("page_id") % 20, F.lit(".c"))
    both = t.table(spark, d, "pages", "page_id", "url").select(path.alias("path"), F.concat(F.lit("F"), (F.col("page_id") * 3 + 1) % 20, F.lit(".c")).alias("name"))
    return file_index.resolved(both.select("name", F.col("path").alias("hint")).distinct(), both.select("path").distinct()).select("hint", "name", "path", "far")


@query(f"WITH {ITEMS_SQL} SELECT 'dir=' || source || '_results/name=part' || chunk || '_analysis' AS folder, true AS filled FROM f WHERE source <> 'src3'")
def files_listing(spark, d):
    """Files below a folder by patterns, folders left out, without reading any."""
    found = file_index.listed(spark, _write_files(spark, d), pattern="*.txt", extensions=["txt"], exclude=["dir=src3_results"])
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), (F.col("length") > 0).alias("filled"))


@query("SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders")
def store_pages(spark, d):
    """A stored table gone through in pages of 1,000 rows, each row once; it lies in the shared folder, so that any executor reads it."""
    path = _folder(spark, "paged")
    t.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s")).write.parquet(path)
    return pages.numbered(spark.read.parquet(path), "k").select("k", "c", "s")
