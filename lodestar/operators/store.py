"""Keyed stores as tables: upsert, purge, retention, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key of both; max_by combines before the shuffle, so hot keys cost a row per task."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def retained(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows no older than `days` before the newest."""
    newest = F.broadcast(df.agg(F.max(ts).alias("_m")))
    return df.crossJoin(newest).where(F.col(ts) >= F.col("_m") - F.expr(f"INTERVAL {days} DAY")).drop("_m")


def purged(stored: DataFrame, current: DataFrame, keys: list[str], checksum: str) -> DataFrame:
    """Stored rows whose key is unknown to current, or has the same checksum there."""
    now = current.select(*keys, F.col(checksum).alias("_now"))
    return stored.join(now, keys, "left").where(F.col("_now").isNull() | (F.col("_now") == F.col(checksum))).drop("_now")


def probed(wanted: DataFrame, stores: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """wanted with the value of the first store that has the key, and which one."""
    all_ = None
    for i, s in enumerate(stores):
        one = s.select(*keys, F.struct(F.lit(i).alias("store"), F.col(value).alias("value")).alias("_h"))
        all_ = one if all_ is None else all_.unionByName(one)
    first = all_.groupBy(*keys).agg(F.min("_h").alias("_h"))
    return wanted.join(first, keys, "left").select(*wanted.columns, F.col("_h.store").alias("store"), F.col("_h.value").alias(value))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def got_or_created(accounts: DataFrame, asked: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(returned, accounts afterwards) for requests in order: one for a key that is there updates it and returns the row as it
    was; the first for a key that is not there creates it and returns the new row."""
    values = [c for c in asked.columns if c not in (*keys, order)]
    row = lambda *by: F.struct(*[F.col(c) for c in values])
    before = accounts.select(*keys, row().alias("_old"))
    w = Window.partitionBy(*keys).orderBy(order)
    both = asked.select(*keys, order, row().alias("_new"), F.lag(row()).over(w).alias("_last")).join(before, keys, "left")
    was = F.coalesce("_last", "_old")
    back = both.select(*keys, order, F.coalesce(was, F.col("_new")).alias("_r"), was.isNull().alias("created")).select(*keys, order, *[F.col(f"_r.{c}").alias(c) for c in values], "created")
    last = asked.groupBy(*keys).agg(F.max_by(row(), order).alias("_v"))
    after = before.join(last, keys, "full_outer").select(*keys, F.coalesce("_v", "_old").alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
    return back, after


def inserted(results: DataFrame, new: DataFrame, parents: DataFrame, key: str, kind: str, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """(results with new, parents with their counts refreshed): total and one count a kind, of the parents that got rows alone."""
    every = results.unionByName(new)
    touched = new.select(key).distinct()
    counts = every.join(touched, key, "left_semi").groupBy(key).agg(F.count("*").alias("_total"), *[F.count_if(F.lower(kind) == k).alias(f"_{k}") for k in kinds])
    named = ["total", *kinds]
    return every, parents.join(counts, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in named else F.col(c) for c in parents.columns])


def changed_content(index: DataFrame, files: DataFrame) -> DataFrame:
    """files(path, md5, ...) that index(path, md5) does not have with this content."""
    return files.join(index.select("path", F.col("md5").alias("_m")), "path", "left").where(~F.col("md5").eqNullSafe(F.col("_m"))).drop("_m")


def moved(files: DataFrame, sources: DataFrame) -> DataFrame:
    """files(name, file_path) with `source`, the first of sources(path) that they belong to, null for those that stay: the path
    in the file ends with the source's, in whole components, and the file's name holds the source's name without its ending."""
    parts = F.split("file_path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    met = files.select("name", "file_path", F.explode(ends).alias("path")).join(sources.select("path").distinct(), "path")
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    hit = met.where(F.contains("name", base)).groupBy("name", "file_path").agg(F.min("path").alias("source"))
    return files.join(hit, ["name", "file_path"], "left")
