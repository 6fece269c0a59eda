"""Triage of findings: allow-lists, reasons to drop, known false positives, scopes, baselines, directories."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans import scratch
from . import findings

#: What fields of a finding without consequence look like, matched without regard to case.
NO_IMPACT = (
    r"^\s*none\.?\s*$", r"\bno\s+(measurable|real[- ]world|performance|significant)\s+(impact|effect)\b", r"^\s*negligible\.?\s*$",
    r"\bimpact\s+is\s+(none|negligible|minimal|zero)\b", r"^\s*no\s+impact\.?\s*$", r"^\s*minimal\.?\s*$",
)
NO_SOLUTION = (
    r"\bno\s+action\s+(required|needed)\b", r"\bno\s+change\s+(required|needed)\b", r"\bno\s+fix\s+(required|needed)\b", r"\bno\s+optimization\s+(required|needed|necessary)\b",
    r"\bno\s+modification\s+(required|needed)\b", r"^\s*not\s+applicable\.?\s*$", r"^\s*n/?a\.?\s*$", r"^\s*none\.?\s*$",
)
NO_ISSUE = (
    r"\bno\s+issue(s)?\s+(found|identified|detected)\b", r"\bworking\s+as\s+intended\b", r"\b(expected|normal|standard)\s+behavior\b",
    r"\bno\s+(performance\s+)?(problem|issue|concern)(s)?\b", r"\bthis\s+is\s+(normal|expected|standard)\b", r"\bno\s+optimization\s+(opportunity|opportunities)\b",
)


def allowed_category(category: Column, allowed: tuple[str, ...] = ("logicBug", "performance")) -> Column:
    """Exact case after trimming; a missing category is not allowed."""
    return F.coalesce(F.trim(category).isin(*allowed), F.lit(False))


def no_consequence(impact: Column, solution: Column, issue: Column) -> Column:
    """Which field says that there is nothing to do, or null."""
    said = lambda c, patterns: F.coalesce(F.trim(c), F.lit("")).rlike("(?i)" + "|".join(patterns))
    return F.when(said(impact, NO_IMPACT), "impact").when(said(solution, NO_SOLUTION), "solution").when(said(issue, NO_ISSUE), "issue")


def without_known(issues: DataFrame, known: DataFrame, checksum: str = "checksum", title: str = "title") -> DataFrame:
    """issues less those known(checksum, title) by checksum and trimmed, lower-cased title; `unknown` and empty checksums match nothing."""
    real = lambda c: (F.coalesce(F.trim(c), F.lit("")) != "") & (F.lower(F.trim(c)) != "unknown")
    k = known.where(real(F.col(checksum))).select(F.trim(checksum).alias("_c"), F.lower(F.trim(title)).alias("_t")).distinct()
    return issues.join(k, (F.trim(F.col(checksum)) == F.col("_c")) & (F.lower(F.trim(F.col(title))) == F.col("_t")) & real(F.col(checksum)), "left_anti")


def in_scope(path: Column, include: list[str], exclude: list[str], files: list[str]) -> Column:
    """Whether a file is analysed: excluded files never; then folders to include; then folders to exclude, unless the
    including folder is the same one or lies inside it. A folder is a beginning of the path or consecutive parts of it."""
    p = text.relative(path)
    bare = lambda v: v.lstrip("./")
    inside = lambda f: p.startswith(f + "/") | (p == f) | text.has_component(p, F.lit(f))
    any_ = lambda conds: reduce(lambda a, b: a | b, conds, F.lit(False))
    out = any_([(p == bare(f)) | p.endswith("/" + bare(f)) for f in files])
    holds = lambda a, b: f"/{b}/" in f"/{a}/"
    if not include:
        return ~out & ~any_([inside(bare(e)) for e in exclude])
    chosen = F.lit(False)
    for i in reversed([bare(i) for i in include]):  # the first folder that holds the file decides
        barred = [e for e in map(bare, exclude) if e != i and not (holds(i, e) and not holds(e, i))]
        chosen = F.when(inside(i), ~any_([inside(e) for e in barred])).otherwise(chosen)
    return ~out & chosen


def selected(name: Column, path: Column, verified: list[str], files: list[str], scope: Column) -> Column:
    """A list of functions decides where there is one, then a list of files, then folders; an unknown file is kept."""
    if verified:
        return name.isin(*verified)
    if files:
        return path.isNull() | path.isin(*files)
    return path.isNull() | scope


def fit_length(lines: Column, least: int = 7, most: int = 1000) -> Column:
    """Zero means unknown and is kept."""
    return (lines <= 0) | lines.between(least, most)


def line_count(*known: Column, first: Column, last: Column) -> Column:
    """The first positive count, else the length of the range, else zero."""
    return F.coalesce(*[F.when(k > 0, k) for k in known], F.when((first > 0) & (last >= first), last - first + 1), F.lit(0))


def matching(**wanted) -> Column:
    """Every key present and equal."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(k) == F.lit(v), F.lit(False)) for k, v in wanted.items()], F.lit(True))


def highest_folders(folders: DataFrame, col: str = "path") -> DataFrame:
    """folders less those inside another of them."""
    parts = F.split(col, "/")
    above = folders.select(F.col(col).alias("_p"), F.explode(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))).alias("_a"))
    held = above.join(folders.select(F.col(col).alias("_a")).distinct(), "_a", "left_semi").select(F.col("_p").alias(col)).distinct()
    return folders.join(held, col, "left_anti")


def rolled_up(files: DataFrame) -> DataFrame:
    """The highest folders of files(path, excluded) in which every file is excluded."""
    under = findings.directories(files, "path").groupBy("prefix").agg(F.bool_and("excluded").alias("all")).where("all").select(F.col("prefix").alias("path"))
    return highest_folders(under)


def signature(path: Column, function: Column, lines: Column, said: Column) -> Column:
    """What makes a finding the same one in two runs."""
    return F.sha2(F.lower(F.concat_ws("::", path, function, lines, said)), 256)


def directory_of(path: Column) -> Column:
    """The folder of a finding: uncategorized without a path, root for a bare file, a bare name as it is."""
    bare = F.trim(path)
    return (
        F.when(F.coalesce(bare, F.lit("")) == "", "uncategorized").when(F.contains(path, F.lit("/")), F.coalesce(F.nullif(F.regexp_replace(path, "/[^/]*$", ""), F.lit("")), F.lit("root")))
        .when(F.contains(path, F.lit("\\")), F.coalesce(F.nullif(F.regexp_replace(path, r"\\[^\\]*$", ""), F.lit("")), F.lit("root")))
        .when(F.contains(bare, F.lit(".")) & ~F.startswith(bare, F.lit(".")), "root").otherwise(bare)
    )


def assigned(issues: DataFrame, files: DataFrame) -> DataFrame:
    """issues(path) with `node`, the folder of files(path) that they belong to: by whole path, else by a base name that
    only one folder has; null where there is none or more than one."""
    placed = files.select("path", text.folder(F.col("path")).alias("node")).distinct()
    names = placed.select(text.base_name(F.col("path")).alias("_n"), "node").distinct().groupBy("_n").agg(F.min("node").alias("_by_name"), F.count("*").alias("_k")).where("_k = 1").drop("_k")
    out = issues.join(placed.withColumnRenamed("node", "_by_path"), "path", "left").withColumn("_n", text.base_name(F.col("path"))).join(names, "_n", "left")
    return out.withColumn("node", F.coalesce("_by_path", "_by_name")).drop("_n", "_by_name", "_by_path")


def folder_summary(issues: DataFrame) -> DataFrame:
    """Per folder and everything in it: findings, by severity, files, folders right below."""
    every = findings.directories(issues, "file_path").withColumn("below", F.element_at(F.split(F.substr("file_path", F.length("prefix") + 2), "/"), 1))
    deeper = F.contains(F.substr("file_path", F.length("prefix") + 2), F.lit("/"))
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in findings.SEVERITIES]
    return every.groupBy("prefix").agg(F.count("*").alias("issues"), *counts, F.countDistinct("file_path").alias("files"), F.countDistinct(F.when(deeper, F.col("below"))).alias("folders"))


BLOCK = 4_096  # rows that one task goes through at once


def batched(rows: DataFrame, by: str, order: str, cost: str, budget: int, most: int) -> DataFrame:
    """rows with `batch`, a number from 0 within each `by`: in order, a batch is closed when the next row would exceed the
    budget or it has `most` rows. order is unique within `by`, costs are not negative.

    Where a batch begins depends on all rows before it, but only through how far the last batch reaches into a block of
    rows, which is less than `most` rows. So each block is gone through by itself for every such beginning, the short
    tables of what comes out of each are followed from block to block, and blocks are numbered from where they are entered.
    No task gets more than a block of rows, whatever the sizes of the `by`.
    """
    at = scratch.ranked(rows.select(by, order, F.col(cost).cast("long").alias("c")), [by, order], "_at")
    begin = at.groupBy(by).agg(F.min("_at").alias("_first"))
    placed = at.join(begin, by).select(by, order, "c", (F.col("_at") - F.col("_first")).alias("at")).checkpoint()
    block, inside = F.floor(F.col("at") / BLOCK), F.col("at") % BLOCK
    ahead = F.when((inside < most) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))  # what a last batch may take of the next block
    blocks = placed.select(by, order, "c", "at", F.explode(ahead).alias("block"))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}

    def nexts(table: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
        table = table.sort_by("at")
        place = table.column("at").to_numpy() - int(table.column("block")[0].as_py()) * BLOCK
        total = np.concatenate(([0], np.cumsum(table.column("c").to_numpy())))
        row = np.arange(len(place))
        reach = np.searchsorted(total, total[:-1] + budget, side="right") - 1
        return table, np.maximum(np.minimum(np.minimum(row + most, reach), len(place)), row + 1), int((place < BLOCK).sum())

    def through(table: pa.Table) -> pa.Table:
        table, after, own = nexts(table)
        leave, count = np.zeros(own + most + 1, np.int64), np.zeros(own + most + 1, np.int64)
        leave[own:] = np.arange(most + 1)  # a batch of an earlier block ends beyond a short last block
        for p in range(own - 1, -1, -1):
            q = int(after[p])
            leave[p], count[p] = (q - own, 1) if q >= own else (leave[q], count[q] + 1)
        return pa.table([table.column(by)[:1], table.column("block")[:1], pa.array([leave[:most].tolist()]), pa.array([count[:most].tolist()])], names=[by, "block", "leave", "count"])

    found = blocks.groupBy(by, "block").applyInArrow(through, f"{by} {kinds[by]}, block bigint, leave array<bigint>, count array<bigint>")
    listed = found.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("block", "leave", "count"))).alias("l"))  # a row a block
    start = F.struct(F.lit(0).cast("long").alias("enter"), F.lit(0).cast("long").alias("batch"), F.array().cast("array<struct<block:bigint,enter:bigint,batch:bigint>>").alias("out"))

    def follow(s: Column, x: Column) -> Column:
        e = s["enter"].cast("int")
        return F.struct(F.get(x["leave"], e).alias("enter"), (s["batch"] + F.get(x["count"], e)).alias("batch"), F.array_append(s["out"], F.struct(x["block"].alias("block"), s["enter"].alias("enter"), s["batch"].alias("batch"))).alias("out"))

    entered = listed.select(by, F.explode(F.aggregate("l", start, follow, lambda s: s["out"])).alias("e")).select(by, "e.block", "e.enter", "e.batch")

    def number(table: pa.Table) -> pa.Table:
        table, after, own = nexts(table)
        begins = np.zeros(len(after), np.int64)
        p = int(table.column("enter")[0].as_py())
        while p < own:
            begins[p] = 1
            p = int(after[p])
        batch = int(table.column("batch")[0].as_py()) - 1 + np.cumsum(begins)
        return pa.table([table.column(by)[:own], table.column(order)[:own], pa.array(batch[:own])], names=[by, order, "batch"])

    each = blocks.join(entered, [by, "block"]).groupBy(by, "block").applyInArrow(number, f"{by} {kinds[by]}, {order} {kinds[order]}, batch bigint")
    return rows.join(each, [by, order])


def capped(rows: DataFrame, by: str, order: list, per: int, total: int) -> DataFrame:
    """At most `per` rows of each `by`, and `total` in all, groups in order of `by`."""
    few = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= per)
    return few.orderBy(by, "_k").limit(total).drop("_k")
