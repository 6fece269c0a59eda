"""Readers of result files, trace text and unified diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ISSUE = "struct<issue:string,severity:string,category:string,file_path:string,function_name:string,line_number:string,description:string>"


def results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Issues of wrappers {file_path, function, checksum, results[]}, one a file or, with lines, one a line; the wrapper fills
    what an issue lacks."""
    schema = f"file_path string, function string, checksum string, results array<{ISSUE}>, _corrupt_record string"
    raw = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    one = raw.where(F.col("_corrupt_record").isNull()).select("file_path", "function", "checksum", F.explode("results").alias("r"))
    return one.select(
        "r.issue", "r.severity", "r.category", F.coalesce(F.nullif("r.file_path", F.lit("")), "file_path").alias("file_path"),
        F.coalesce(F.nullif("r.function_name", F.lit("")), "function").alias("function_name"), F.expr("try_cast(r.line_number AS int)").alias("line_number"), "r.description", "checksum",
    )


FRAME = r"^\s*([0-9.]+)%\s+\(([0-9]+)\)\s+(\S+)\s+(.*?)(?:\s+\(([^)]*)\))?\s*$"


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Frames of text traces (file, trace, pos, percent, cost, library, function, source); other lines are skipped."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"(?m)^=====\s*$")).alias("trace", "body"))
    lines = raw.select("file", "trace", F.posexplode(F.split("body", "\n")).alias("pos", "line")).where(F.col("line").rlike(FRAME))
    part = lambda i: F.regexp_extract("line", FRAME, i)
    return lines.select("file", "trace", "pos", part(1).cast("double").alias("percent"), part(2).cast("long").alias("cost"), part(3).alias("library"), part(4).alias("function"), part(5).alias("source"))


def changed_lines(lines: DataFrame) -> DataFrame:
    """(file, line, kind) of unified diffs given as lines(diff, pos, value): running windows, one diff at a time."""
    w = Window.partitionBy("diff").orderBy("pos")
    head = F.regexp_extract("value", r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)", 1)
    body = lines.select(
        "diff", "pos", "value",
        F.last(F.when(F.col("value").startswith("+++ "), F.regexp_replace("value", r"^\+\+\+ (?:b/)?", "")), ignorenulls=True).over(w).alias("file"),
        F.last(F.when(head != "", F.nullif(head, F.lit("")).cast("long")), ignorenulls=True).over(w).alias("start"),
        F.count_if(F.col("value").startswith("@@")).over(w).alias("hunk"),
    ).where((F.col("hunk") > 0) & ~F.col("value").startswith("@@") & ~F.col("value").rlike(r"^(\+\+\+ |--- |diff |index )"))
    h = Window.partitionBy("diff", "file", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.count_if(~F.col("value").startswith("-")).over(h), F.lit(0))
    kind = F.when(F.col("value").startswith("+"), "added").when(F.col("value").startswith("-"), "removed")
    return body.withColumn("line", F.col("start") + ahead).withColumn("kind", kind).where("kind IS NOT NULL").select("diff", "file", "line", "kind")


def hunks(lines: DataFrame) -> DataFrame:
    """(diff, file, hunk, old_first, old_last, new_first, new_last) of unified diffs given as lines(diff, pos, value).

    Hunks are numbered from 1 within a diff. A side without lines (a length of 0) ends one line before it begins.
    """
    w = Window.partitionBy("diff").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    value = F.col("value")
    file = F.last(F.when(value.startswith("+++ "), F.regexp_replace(value, r"^\+\+\+ (?:b/)?", "")), ignorenulls=True).over(w)
    head = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda i: F.nullif(F.regexp_extract(value, head, i), F.lit("")).cast("int")
    heads = lines.where(value.startswith("+++ ") | value.rlike(head))  # no other line tells a file or a hunk
    found = heads.select("diff", "pos", "value", file.alias("file"), F.count_if(value.rlike(head)).over(w).cast("int").alias("hunk")).where(value.rlike(head))
    side = lambda i: (part(i), part(i) + F.coalesce(part(i + 1), F.lit(1)) - 1)
    (a, z), (b, y) = side(1), side(3)
    return found.select("diff", "file", "hunk", a.alias("old_first"), z.alias("old_last"), b.alias("new_first"), y.alias("new_last"))
