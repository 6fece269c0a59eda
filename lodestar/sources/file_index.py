"""Files of a repository, and names resolved to the nearest of several files that bear them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn


def listed(spark: SparkSession, path: str, *, pattern: str | None = None, extensions: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, length) of the files below a folder, without their contents, paths relative to it.

    include and exclude name folders by one or more whole components; exclude wins. Extensions are in lower case.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    root = spark.createDataFrame([(path.rstrip("/"),)], "root string")
    at = reader.load(path).select("path", "length")
    # the reader gives full paths with their scheme; the root may have been given without one
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    out = at.crossJoin(F.broadcast(root)).select(F.substr(plain, F.length(F.regexp_replace("root", "^[a-z]+:/+", "/")) + 2).alias("path"), "length")
    if extensions is not None:
        out = out.where(fn.extension(F.col("path")).isin(extensions))
    folder = fn.folder(F.col("path"))
    if include:
        out = out.where(_any(folder, include))
    if exclude:
        out = out.where(~_any(folder, exclude))
    return out


def _any(folder: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | fn.has_component(folder, F.lit(p))
    return found


def _above(path: Column) -> Column:
    """The folders that hold a path, from the root (empty) down to its own."""
    parts = F.filter(F.split(fn.folder(path), "/"), lambda p: ~p.isin("", "."))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def resolved(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(name, hint) with the path of files(path) that bears the name, in any case of letters, nearest to the folder of hint.

    Near is what has the fewest components below the deepest folder shared with the hint, ties by path; without a
    hint all files are as near as from the root; null where no file has the name. Each file stands for itself in each of
    its folders, where only the nearest one of a name is kept; a hint looks up its own folders. So a name
    that many files bear is never joined with all of them.
    """
    name = F.lower(fn.base_name(F.col("path")))
    depth = F.size(F.split("path", "/"))
    held = files.select(name.alias("_n"), "path", depth.alias("_d"), F.posexplode(_above(F.col("path"))).alias("_k", "_a"))
    best = held.groupBy("_n", "_a").agg(F.min(F.struct((F.col("_d") - F.col("_k")).alias("far"), "path")).alias("_b"))
    asked = wanted.select("name", "hint").distinct()
    looked = asked.select("name", "hint", F.lower(fn.base_name(F.col("name"))).alias("_n"), F.explode(_above(F.coalesce("hint", F.lit("x")))).alias("_a"))
    near = looked.join(best, ["_n", "_a"]).groupBy("name", "hint").agg(F.min("_b").alias("_b"))
    same = (wanted["name"] == near["name"]) & wanted["hint"].eqNullSafe(near["hint"])
    return wanted.join(near, same, "left").select(wanted["*"], F.col("_b.path").alias("path"), F.col("_b.far").alias("far"))
