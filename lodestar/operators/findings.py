"""Findings: normalising, filtering with reasons, de-duplication and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")


def first_filled(*cols: str | Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def problems(title: str, severity: str, category: str) -> Column:
    """What is wrong with a finding, as an array; empty if valid."""
    return F.array_compact(F.array(
        F.when(first_filled(title).isNull(), "no title"),
        F.when(first_filled(category).isNull(), "no category"),
        F.when(~F.coalesce(F.lower(severity).isin(*SEVERITIES), F.lit(False)), "bad severity"),
    ))


def cascaded(df: DataFrame, levels: list[tuple[str, Column]]) -> DataFrame:
    """dropped_at: the first level whose condition holds, null for survivors; one pass, no join."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(levels):
        out = F.when(cond, name).otherwise(out)
    return df.withColumn("dropped_at", out)


def first_by_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def directories(df: DataFrame, path: str) -> DataFrame:
    """A row per directory prefix of a path, the file name left out."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    prefixes = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))
    return df.withColumn("prefix", F.explode(prefixes))


def pivoted(df: DataFrame, key: str, severity: str) -> DataFrame:
    counts = [F.count_if(F.lower(severity) == s).alias(s) for s in SEVERITIES]
    return df.groupBy(key).agg(F.count("*").alias("total"), *counts)
