"""Changes: changed lines, hunks and versions against functions(name, file, first, last) and calls(src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import graph


def modified(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(name, file, line) for each line(file, line) inside a function. Files are the same where the paths are equal or one
    ends with the other, so that the base name is a key and the rest of the rule is checked after the join."""
    change = lines.select(F.col("file").alias("changed"), "line", text.base_name(F.col("file")).alias("_n")).distinct()
    ranges = functions.select("name", "file", "first", "last", text.base_name(F.col("file")).alias("_n"))
    hit = graph.in_ranges(change, ranges, "_n", "line", "first", "last")
    return hit.where(text.same_file(F.col("changed"), F.col("file"))).select("name", "file", "line").distinct()


def near_changes(issues: DataFrame, lines: DataFrame, around: int = 2) -> DataFrame:
    """issues(id, file, line_number) with a changed line of their file within `around` lines of theirs. A line number that
    is none is kept; an issue in a file without changes goes; without any changes all stay."""
    if lines.isEmpty():
        return issues
    spot = issues.withColumn("_r", text.line_range(F.col("line_number")))
    spread = lines.select("file", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("_l")).distinct()
    cells = spread.select("file", F.col("_l"), F.floor(F.col("_l") / 64).alias("_cell"))
    wide = spot.where("_r IS NOT NULL").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_r.lo") / 64), F.floor(F.col("_r.hi") / 64))))
    kept = wide.join(cells, ["file", "_cell"]).where(F.col("_l").between(F.col("_r.lo"), F.col("_r.hi"))).select("id").distinct()
    return spot.where("_r IS NULL").drop("_r").unionByName(spot.where("_r IS NOT NULL").drop("_r").join(kept, "id", "left_semi"))


def affected(changed: DataFrame, calls: DataFrame, known: DataFrame, depth: int = 1) -> DataFrame:
    """(name, reason, related): modified functions, then what calls them or is called by them, step by step.

    changed(name) and known(name) are functions; reason is modified, calls_modified or called_by_modified, the
    first that holds; related are the functions of the step before through which it was reached, sorted.
    """
    calls = calls.select("src", "dst").distinct().join(known.select(F.col("name").alias("src")), "src", "left_semi").join(known.select(F.col("name").alias("dst")), "dst", "left_semi")
    seen = changed.select("name", F.lit("modified").alias("reason"), F.lit(0).alias("step")).distinct()
    front, links = seen, []
    for step in range(1, depth + 1):
        up = front.select(F.col("name").alias("dst")).join(calls, "dst").select(F.col("src").alias("name"), F.col("dst").alias("by"), F.lit("calls_modified").alias("reason"))
        down = front.select(F.col("name").alias("src")).join(calls, "src").select(F.col("dst").alias("name"), F.col("src").alias("by"), F.lit("called_by_modified").alias("reason"))
        both = up.unionByName(down).where("name <> by")
        links.append(both.select("name", "by"))
        front = both.groupBy("name").agg(F.min(F.when(F.col("reason") == "calls_modified", 0).otherwise(1)).alias("r"))
        front = front.select("name", F.when(F.col("r") == 0, "calls_modified").otherwise("called_by_modified").alias("reason"), F.lit(step).alias("step")).join(seen, "name", "left_anti")
        seen = seen.unionByName(front)
    if not links:
        return seen.select("name", "reason", F.array().cast("array<string>").alias("related"))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    related = every.groupBy("name").agg(F.array_sort(F.collect_set(F.col("by").cast("string"))).alias("related"))
    return seen.join(related, "name", "left").select("name", "reason", F.coalesce("related", F.array().cast("array<string>")).alias("related"))


def related(name: object, calls: DataFrame, changed: DataFrame) -> DataFrame:
    """Callers and callees of one function, and whether each is modified."""
    around = calls.where(F.col("src") == name).select(F.col("dst").alias("name"), F.lit("callee").alias("side")).union(calls.where(F.col("dst") == name).select(F.col("src"), F.lit("caller")))
    return around.distinct().join(changed.select("name", F.lit(True).alias("is_modified")).distinct(), "name", "left").fillna(False, ["is_modified"])


def callers_of(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """functions(name) with `invoked_by`, one entry a call, sorted; empty where there is none."""
    by = calls.groupBy(F.col("dst").alias("name")).agg(F.array_sort(F.collect_list("src")).alias("invoked_by"))
    return functions.join(by, "name", "left").withColumn("invoked_by", F.coalesce("invoked_by", F.array().cast(by.schema["invoked_by"].dataType)))


def grown(hunks: DataFrame, functions: DataFrame) -> DataFrame:
    """hunks(hunk, file, first, last) grown to the functions of their file that they overlap: first and last line."""
    cell = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 64), F.floor(F.col(b) / 64)))
    left = hunks.select("hunk", "file", F.col("first").alias("a"), F.col("last").alias("z")).withColumn("_cell", cell("a", "z"))
    right = functions.select("file", "first", "last").withColumn("_cell", cell("first", "last"))
    met = left.join(right, ["file", "_cell"]).where("first <= z AND last >= a").groupBy("hunk").agg(F.min("first").alias("_f"), F.max("last").alias("_l"))
    out = hunks.join(met, "hunk", "left")
    return out.withColumn("first", F.least("first", "_f")).withColumn("last", F.greatest("last", "_l")).drop("_f", "_l")


def padded(first: Column, last: Column, length: Column, lines: int) -> tuple[Column, Column]:
    """A range with `lines` more on both sides, inside its file."""
    return F.greatest(F.lit(1), first - lines), F.least(length, last + lines)


def marked(lines: DataFrame, changed: DataFrame) -> DataFrame:
    """lines(file, line, value) with `+` or `-` or a blank in front, from changed(file, line, kind)."""
    kinds = changed.groupBy("file", "line").agg(F.max(F.col("kind") == "added").alias("_a"), F.max(F.col("kind") == "removed").alias("_r"))
    mark = F.when(F.col("_a"), "+").when(F.col("_r"), "-").otherwise(" ")
    return lines.join(kinds, ["file", "line"], "left").withColumn("value", F.concat(mark, "value")).drop("_a", "_r")


def new_or_changed(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """later(name, checksum) that earlier does not have, or has with another checksum."""
    old = earlier.select("name", F.col("checksum").alias("_old"))
    return later.join(old, "name", "left").withColumn("status", F.when(F.col("_old").isNull(), "new").when(~F.col("checksum").eqNullSafe(F.col("_old")), "changed")).where("status IS NOT NULL").drop("_old")


def innermost(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """lines(file, line) with `name`, the smallest range that holds the line, the first by name where two are as small."""
    hit = graph.in_ranges(lines, ranges, "file", "line", "first", "last")
    return hit.groupBy("file", "line").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("size"), "name")).alias("_b")).select("file", "line", F.col("_b.name").alias("name"))


def resolved(names: DataFrame, registry: DataFrame) -> DataFrame:
    """names(asked) with `name` and `how`: the registry(name) entry that is equal, else the one with the same base name (the
    first by the alphabet), in that order of preference."""
    exact = registry.select(F.col("name").alias("asked"), F.col("name").alias("_exact")).distinct()
    base = registry.select(text.unqualified(F.col("name")).alias("_b"), "name").groupBy("_b").agg(F.min("name").alias("_base"))
    out = names.join(exact, "asked", "left").withColumn("_b", text.unqualified(F.col("asked"))).join(base, "_b", "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_base").isNotNull(), "base")
    return out.select(*names.columns, F.coalesce("_exact", "_base").alias("name"), how.alias("how"))


def by_keywords(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(id, file, words) with the right(name, file, words) of the same file that shares most words, at least one, the
    first by name of equals: id, name, overlap. Only different sets of words of a file that share a word meet: rows of
    one set get the same answer, and of equal sets on the right only the first name can be taken."""
    words = F.array_sort(F.array_distinct("words"))
    a = left.select("id", "file", words.alias("_a"))
    b = right.groupBy("file", words.alias("_b")).agg(F.min("name").alias("name"))
    both = a.select("file", "_a").distinct().withColumn("_w", F.explode("_a")).join(b.withColumn("_w", F.explode("_b")), ["file", "_w"])
    shared = both.groupBy("file", "_a", "_b").agg(F.count("*").alias("overlap"), F.first("name").alias("name"))
    best = shared.groupBy("file", "_a").agg(F.min(F.struct((-F.col("overlap")).alias("k"), "name")).alias("_m"))
    return a.join(best, ["file", "_a"]).select("id", F.col("_m.name").alias("name"), (-F.col("_m.k")).alias("overlap"))


def continuous(lines: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """Rows whose number is not the one before plus one."""
    before = F.lag(number).over(Window.partitionBy(key).orderBy(order))
    return lines.withColumn("expected", before + 1).where(F.col(number) != F.col("expected"))


def edges_of_files(entries: DataFrame, body: str) -> DataFrame:
    """(file, src, dst) of call graphs as JSON: a list of {file, functions: [{function, functions_invoked}]}, each callee a
    name or an object {function, functions_invoked} of any depth."""
    import json

    import pyarrow as pa

    def calls(function: dict):
        stack = [function]
        while stack:
            f = stack.pop()
            for callee in f.get("functions_invoked") or []:
                if isinstance(callee, dict):
                    stack.append(callee)
                yield f.get("function"), callee.get("function") if isinstance(callee, dict) else callee

    def run(batches):
        for b in batches:
            rows = [(entry.get("file"), s, d) for t in b.column(0).to_pylist() for entry in json.loads(t) for f in entry.get("functions") or [] for s, d in calls(f)]
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["file", "src", "dst"])

    return entries.select(body).mapInArrow(run, "file string, src string, dst string").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
