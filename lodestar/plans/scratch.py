"""Where loops leave their checkpoints, and row numbers without a single task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder from spark.checkpoint.dir; a temporary one where none is set, in local mode alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="lodestar-"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, key: str, rows: int = 250_000) -> DataFrame:
    """df in partitions by the hash of a key, as many as its rows need, so that what a task holds does not grow with the table.

    Rows are counted first; of a table in Parquet that reads no column.
    """
    return df.repartition(max(partitions(df.sparkSession), -(-df.count() // rows)), key)


def ranked(df: DataFrame, order: list, name: str, total: str | None = None) -> DataFrame:
    """df with `name`, a row's place from 0 in the order (which should be total), and the number of rows as `total`.

    Rows are dealt by ranges of the order and numbered inside each; only a row per range goes through one task.
    """
    checkpoints(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_s"), F.sum("_n").over(Window.partitionBy()).alias("_t"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    out = dealt.withColumn("_r", inside).join(F.broadcast(start), "_p").withColumn(name, (F.col("_s") + F.col("_r")).cast("long"))
    return (out.withColumnRenamed("_t", total) if total else out.drop("_t")).drop("_p", "_r", "_s")
