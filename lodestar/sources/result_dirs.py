"""Scans of folders with result files, whole or broken, in one pass: issues, and what was read of each folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, names: str = "*_analysis*") -> DataFrame:
    """(folder, name, size, kind, items) of every file below path whose name, or whose folder's, matches.

    kind is list, object, other (JSON, but neither) or broken (no JSON, or only white space); items are a list's members or the
    object. Files of no bytes at all are passed over, as by all of Spark's readers.
    """
    like = names.replace(".", r"\.").replace("*", "[^/]*")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("path").rlike(f"/{like}(/[^/]*)?$"))
    raw = raw.select(F.col("path").alias("at"), F.col("length").alias("size"), F.try_parse_json(F.col("content").cast("string")).alias("v"))
    shape = F.schema_of_variant("v")
    kind = F.when(F.col("v").isNull(), "broken").when(shape.startswith("ARRAY"), "list").when(shape.startswith("OBJECT"), "object").otherwise("other")
    items = F.when(F.col("kind") == "list", F.try_variant_get("v", "$", "array<variant>")).when(F.col("kind") == "object", F.array("v"))
    return raw.select(F.regexp_replace("at", "/[^/]*$", "").alias("folder"), F.regexp_extract("at", "[^/]*$", 0).alias("name"), "size", kind.alias("kind"), "v").withColumn("items", items).drop("v")


def issues(spark: SparkSession, path: str, names: str = "*_analysis*", *, watch: Observation | None = None) -> DataFrame:
    """(folder, name, pos, item): the objects in the files of a folder tree; other members of lists are left out.

    With watch, an action on the result also counts, in the same pass, files, those processed and those with errors
    (broken, neither list nor object, or with members that are not objects; such lists are processed as well).
    """
    read = files(spark, path, names)
    if watch is not None:
        odd = F.coalesce(F.exists("items", lambda x: ~is_object(x)), F.lit(False))
        read = read.observe(watch, F.count("*").alias("files"), F.count_if(F.col("items").isNotNull()).alias("processed"), F.count_if(F.col("items").isNull() | odd).alias("with_errors"))
    each = read.select("folder", "name", F.posexplode("items").alias("pos", "item"))
    return each.where(is_object(F.col("item")))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def text(item: str, key: str, default: str | None = None) -> Column:
    got = F.try_variant_get(item, f"$.{key}", "string")
    return got if default is None else F.coalesce(got, F.lit(default))


def statistics(spark: SparkSession, path: str, names: str = "*_analysis*") -> DataFrame:
    """(folder, what, value, n) of each folder: files, valid, invalid, issues, with_callstack, and how often each
    severity, file_path and function occurs (missing: unknown). One scan and one shuffle, of partial counts."""
    read = files(spark, path, names)
    valid = F.col("kind") != "broken"
    first = F.get("items", F.lit(0))
    one = lambda what, value, n: F.struct(F.lit(what).alias("what"), value.alias("value"), n.cast("int").alias("n"))
    with_stack = F.coalesce(F.try_variant_get(first, F.lit("$.original_callstack"), "variant").isNotNull(), F.lit(False))
    counts = {"files": F.lit(1), "valid": valid, "invalid": ~valid, "issues": F.coalesce(F.size("items"), F.lit(0)), "with_callstack": with_stack}
    of_file = F.array(*[one(what, F.lit(""), n) for what, n in counts.items()])

    def of_item(v: Column) -> Column:
        get = lambda key: F.coalesce(F.try_variant_get(v, f"$.{key}", "string"), F.lit("unknown"))
        return F.array(one("severity", F.lower(get("severity")), F.lit(1)), one("file_path", get("file_path"), F.lit(1)), one("function", get("function_name"), F.lit(1)))

    of_items = F.flatten(F.transform(F.filter(F.coalesce("items", F.array().cast("array<variant>")), is_object), of_item))
    kinds = "array<struct<what:string,value:string,n:int>>"
    each = read.select("folder", F.explode(F.concat(of_file.cast(kinds), of_items.cast(kinds))).alias("c"))
    return each.groupBy("folder", "c.what", "c.value").agg(F.sum("c.n").alias("n"))
