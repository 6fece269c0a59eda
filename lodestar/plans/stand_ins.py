"""Relations of the code-analysis domain, built from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as issues: id, title, file_path, directory, severity, category, body."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    severity = F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "high").when(F.col("quality") == 1, "low").otherwise("unknown")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.left("text", F.lit(60)).alias("title"), F.col("text").alias("body"), path.alias("file_path"), F.concat_ws("/", "source", "lang").alias("directory"), severity.alias("severity"), F.col("lang").alias("category"), "source"
    )


ISSUES_SQL = """issues AS (
  SELECT d.doc_id, left(d.text, 60) AS title, d.text AS body, d.source || '/' || d.lang || '/' || d.doc_id || '.txt' AS file_path,
         d.source || '/' || d.lang AS directory, d.lang AS category, d.source,
         CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'high' WHEN quality = 1 THEN 'low' ELSE 'unknown' END AS severity
  FROM documents d LEFT JOIN labels USING (doc_id))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile tree region > nation > customer > order > item: node, parent, level, name, own cost."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), F.col("r_name").alias("name"), F.lit(0).cast("long").alias("own"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit(1), "n_name", F.lit(0).cast("long"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.lit(2), "c_mktsegment", F.lit(0).cast("long"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"), F.lit(3), "o_orderpriority", F.floor("o_totalprice").cast("long"))
    return region.union(nation).union(customer).union(orders)


FRAMES_SQL = """frames AS (
  SELECT 'r' || r_regionkey AS node, NULL AS parent, 0 AS level, r_name AS name, 0::BIGINT AS own FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, n_name, 0 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 2, c_mktsegment, 0 FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 3, o_orderpriority, floor(o_totalprice)::BIGINT FROM orders)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph (src, dst) of nations: each calls the two it buys most from, ties by key."""
    item = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    order = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    buyer = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    seller = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    sums = (
        item.join(seller, item["l_suppkey"] == seller["s_suppkey"]).join(order, item["l_orderkey"] == order["o_orderkey"]).join(buyer, order["o_custkey"] == buyer["c_custkey"])
        .groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    )
    return top_per_key(sums.where("src <> dst"), ["src"], [F.desc("q"), F.asc("dst")], 2).select("src", "dst")


CALLS_SQL = """calls AS (
  SELECT src, dst FROM (
    SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY q DESC, dst) AS k FROM (
      SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity::BIGINT) AS q
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)) WHERE k <= 2)"""


def top_per_key(df: DataFrame, keys: list, order: list, n: int) -> DataFrame:
    """The first n rows of each key; the limit is pushed below the shuffle by the engine's window group limit."""
    from pyspark.sql import Window

    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call graph (src, dst) of parts, which grows with lineitem: each calls the two that its successors in orders lead to most.

    A successor leads to a part of the same module (five parts) or of one less than half as far up, so that the graph
    has rings inside modules and is a few calls deep in all.
    """
    item = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    from pyspark.sql import Window

    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    both = item.select(F.col("l_partkey").alias("src"), nxt.alias("b")).where("b IS NOT NULL")
    dst = F.expr("CASE WHEN b % 3 = 0 THEN 5 * (src div 5) + b % 5 ELSE 5 * (((src div 5) * (b % 7 + 1)) div 16) + b % 5 END")
    sums = both.select("src", dst.cast("long").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return top_per_key(sums, ["src"], [F.desc("n"), F.asc("dst")], 2).select("src", "dst")


MODULES_SQL = """mods AS MATERIALIZED (SELECT src, dst FROM (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS k FROM (
    SELECT a AS src, CASE WHEN b % 3 = 0 THEN 5 * (a // 5) + b % 5 ELSE 5 * (((a // 5) * (b % 7 + 1)) // 16) + b % 5 END AS dst FROM (
      SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) WHERE b IS NOT NULL)
  WHERE src <> dst GROUP BY src, dst) WHERE k <= 2)"""
