"""Database tables, lists of known findings and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, url: str, name: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A table over JDBC; with a numeric key and its bounds it is read in `parts` ranges, all rows included."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def write_table(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode(mode).save()


def known_findings(spark: SparkSession, path: str) -> DataFrame:
    """checksum, issue_title, issue_description of CSV lists; lines from # on and rows without checksum are left out."""
    raw = spark.read.csv(path, header=True, comment="#", multiLine=True, escape='"', schema="checksum string, issue_title string, issue_description string")
    return raw.where(F.coalesce(F.trim("checksum"), F.lit("")) != "")


def write_results(results: DataFrame, path: str) -> None:
    """One JSON row per (file_path, function, checksum), issues gathered, over as many files as there are tasks."""
    rest = [c for c in results.columns if c not in ("file_path", "function", "checksum")]
    results.groupBy("file_path", "function", "checksum").agg(F.collect_list(F.struct(*rest)).alias("results")).write.mode("append").json(path)


def write_html(issues: DataFrame, path: str, *cols: str) -> None:
    """Issues as rows of an HTML table, escaped, one text line each."""
    def escaped(c: str):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
            v = F.replace(v, F.lit(a), F.lit(b))
        return v

    cells = [F.concat(F.lit("<td>"), escaped(c), F.lit("</td>")) for c in cols]
    issues.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value")).write.mode("overwrite").text(path)
