"""Write-back of what filters left into a stored table of results, touching only the partitions that lose something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch

REASON = "the issue was stored and did not survive the filters that follow"
LEVEL = "final filter"


def write_back(spark: SparkSession, path: str, surviving: DataFrame, archive: str, part: str = "part") -> DataFrame:
    """Leaves in the table at path(function, file_path, checksum, results, <part>) only issues that surviving(checksum, issue) has.

    Issues are matched by the first eight characters of the checksum and the trimmed issue; rows with a shorter checksum
    are skipped, and so are rows that lose nothing. Removed issues are appended to the archive first, with level and
    reason, so that a run that breaks off in between loses none (it archives them again). Only partitions that lose
    issues are rewritten; a row that loses all of them stays with none. Returns (part, removed) of these.
    """
    scratch.checkpoints(spark)
    stored = spark.read.parquet(path)
    titles = surviving.where(F.length("checksum") >= 8).groupBy(F.left("checksum", F.lit(8)).alias("_c")).agg(F.collect_set(F.trim("issue")).alias("_t"))  # one function's own
    left = stored.join(titles, F.left("checksum", F.lit(8)) == F.col("_c"), "left")
    stays = lambda x: F.coalesce(F.array_contains("_t", F.trim(F.coalesce(x["issue"], F.lit("")))), F.lit(False))
    judged = F.length("checksum") >= 8
    gone = F.when(judged, F.filter("results", lambda x: ~stays(x)))
    removed = left.select(part, "function", "file_path", "checksum", F.explode(gone).alias("issue")).checkpoint()
    touched = removed.groupBy(part).agg(F.count("*").alias("removed")).checkpoint()
    removed.select(part, "function", "file_path", "checksum", F.lit(LEVEL).alias("filter_level"), F.lit(REASON).alias("reason"), "issue").write.mode("append").parquet(archive)
    kept = F.when(judged, F.filter("results", stays)).otherwise(F.col("results"))
    after = left.join(touched.select(part), part, "left_semi").select(*[kept.alias(c) if c == "results" else F.col(c) for c in stored.columns]).checkpoint()
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return touched


def archived(spark: SparkSession, *paths: str, match: Column | None = None) -> DataFrame:
    """What archives hold, folders of any depth together, each removed issue once."""
    found = spark.read.option("recursiveFileLookup", True).parquet(*paths)
    return (found if match is None else found.where(match)).dropDuplicates(["function", "file_path", "checksum", "issue"])
