"""Run events as streams: counters per window and exactly-once keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def counters(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, users and value per window and type; the watermark bounds the state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("value"))


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else timed.dropDuplicates([key])


def _to_end(spark: SparkSession, rows: DataFrame, mode: str) -> DataFrame:
    """Runs a stream until its source is exhausted and gives what it has written, from a folder that all executors share."""
    import uuid

    from ..plans import scratch

    scratch.checkpoints(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={number}")

    run = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out") if mode == "complete" else spark.read.schema(rows.schema).parquet(f"{at}/out/*")


def _source(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(path if path.endswith("/") else path.rsplit("/", 1)[0] + "/" + path.rsplit("/", 1)[1] + "*")


def counted_once(spark: SparkSession, path: str) -> DataFrame:
    """Per event type: events, users, value in cents, successes and failures; the counting is exact, so users are a set."""
    rows = once(_source(spark, path), late="100 days").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    out = rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.collect_set("user_id").alias("u"), F.sum("cents").alias("cents"), F.count_if(F.col("event_type") == "purchase").alias("successful"), F.count_if(F.col("event_type") == "error").alias("failed")
    )
    return _to_end(spark, out, "complete").withColumn("users", F.size("u").cast("long")).drop("u")


def hourly(spark: SparkSession, path: str) -> DataFrame:
    timed = _source(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))
    out = timed.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("events")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "events")
    return _to_end(spark, out, "complete")
