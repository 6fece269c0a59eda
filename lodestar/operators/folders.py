"""Folders of file paths: lookup by name or path, and listings down to a depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folders(files: DataFrame) -> DataFrame:
    """(path, name, depth, files) of each folder above files(path): how many files it holds at any depth."""
    parts = F.split("path", "/")
    each = files.select("path", F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("depth")).where(F.col("depth").between(1, F.size(parts) - 1))
    return each.groupBy(F.array_join(F.slice(parts, 1, F.col("depth")), "/").alias("path"), "depth").agg(F.count("*").alias("files")).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "depth", "files")


def named(files: DataFrame, names: DataFrame) -> DataFrame:
    """Folders that have one of names(name)."""
    return folders(files).join(names.select("name").distinct(), "name", "left_semi")


def listing(files: DataFrame, roots: DataFrame, depth: int = 6) -> DataFrame:
    """(root, path, kind, level): what stands below each of roots(root), folders and files, down to `depth` levels."""
    found = folders(files).select("path", F.lit("folder").alias("kind")).unionByName(files.select("path", F.lit("file").alias("kind")))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("root"), (F.size(parts) - k).cast("int").alias("level")))
    each = found.select("path", "kind", F.explode(F.filter(above, lambda x: x["level"] <= depth)).alias("a")).select("path", "kind", "a.root", "a.level")
    return each.join(roots.select("root").distinct(), "root", "left_semi").select("root", "path", "kind", "level")
