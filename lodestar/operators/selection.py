"""Functions, classes, graphs and diffs restricted to files, and registries and graphs of several languages together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Endings of source files that are analysed.
SOURCES = ["cpp", "cc", "c", "mm", "m", "h", "swift", "kt", "kts", "java", "go"]


def locations(registries: DataFrame, json: str) -> DataFrame:
    """registries' other columns with (function, checksum, file, first, last) of each place in registries as JSON.

    `{name: {checksum, code: [{file_name, start, end}]}}`, or the older `{function_to_location: {name: [{...}]}}`. Values of
    other shapes have no places, and a place without a file none either.
    """
    tvf = registries.sparkSession.tvf
    rest = [c for c in registries.columns if c != json]
    get = lambda v, path, kind: F.try_variant_get(v, f"$.{path}", kind)
    whole = registries.select(*rest, F.try_parse_json(json).alias("_v")).where("_v IS NOT NULL")
    inner = whole.select(*rest, F.coalesce(get("_v", "function_to_location", "variant"), F.col("_v")).alias("_v"))
    each = inner.lateralJoin(tvf.variant_explode(F.col("_v").outer())).where("key IS NOT NULL").select(*rest, F.col("key").alias("function"), "value")
    code = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), get("value", "code", "array<variant>"))
    placed = each.select(*rest, "function", get("value", "checksum", "string").alias("checksum"), F.explode(code).alias("p"))
    first = lambda *names, kind: F.coalesce(*[get("p", n, kind) for n in names])
    out = placed.select(*rest, "function", F.coalesce("checksum", get("p", "checksum", "string")).alias("checksum"), first("file_name", "file", kind="string").alias("file"), first("start", "start_line", kind="int").alias("first"), first("end", "end_line", kind="int").alias("last"))
    return out.where("file IS NOT NULL").distinct()


def in_files(rows: DataFrame, files: DataFrame, path: str = "file") -> DataFrame:
    """Rows whose path is one of files(file), `./` and the like in front left out."""
    wanted = files.select(text.relative(F.col("file")).alias("_p")).distinct()
    return rows.join(wanted, text.relative(F.col(path)) == F.col("_p"), "left_semi")


def missing_files(rows: DataFrame, files: DataFrame, path: str = "file") -> DataFrame:
    """Rows whose path is none of files(file)."""
    wanted = files.select(text.relative(F.col("file")).alias("_p")).distinct()
    return rows.join(wanted, text.relative(F.col(path)) == F.col("_p"), "left_anti")


def functions_of_files(places: DataFrame, files: DataFrame) -> DataFrame:
    """(file, functions): what each of files(file) holds, by its first line; files without any have an empty list."""
    listed = places.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("first", "last", "function"))).alias("functions"))  # a file's own
    empty = F.array().cast(listed.schema["functions"].dataType)
    return files.select("file").distinct().join(listed, "file", "left").select("file", F.coalesce("functions", empty).alias("functions"))


def longest_first(places: DataFrame, least: int = 7, most: int = 1000, head: int | None = None) -> DataFrame:
    """places with `lines`, those of least to most lines, longest first, the first `head`; unknown lengths (0) pass."""
    lines = F.when((F.col("first") > 0) & (F.col("last") > 0), F.col("last") - F.col("first") + 1).otherwise(0)
    fit = places.withColumn("lines", lines).where((F.col("lines") == 0) | F.col("lines").between(least, most)).orderBy(F.desc("lines"), "function", "file")
    return fit if head is None else fit.limit(head)


def holding(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(a, b): names of longer(a) that hold a name of shorter(b), equal ones included.

    Parts of the longer names that are as long as some shorter one are compared by equality, so that no pair is looked at
    that does not match.
    """
    sizes = F.broadcast(shorter.select(F.length("b").alias("k")).distinct().where("k > 0"))  # as many rows as a name has letters
    at = longer.select("a").distinct().join(sizes, F.length("a") >= F.col("k")).select("a", "k", F.explode(F.sequence(F.lit(1), F.length("a") - F.col("k") + 1)).alias("i"))
    parts = at.select("a", F.substr("a", F.col("i"), F.col("k")).alias("b")).distinct()
    return parts.join(shorter.select("b").distinct(), "b").select("a", "b")


def touching(graph: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of graph(file, ...) whose file holds one of targets(file) or is held by one."""
    names, wanted = graph.select("file").distinct(), targets.select("file").distinct()
    over = holding(names.select(F.col("file").alias("a")), wanted.select(F.col("file").alias("b"))).select(F.col("a").alias("file"))
    under = holding(wanted.select(F.col("file").alias("a")), names.select(F.col("file").alias("b"))).select(F.col("b").alias("file"))
    return graph.join(over.union(under).distinct(), "file", "left_semi")


def class_files(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """(asked, name, file) for asked(asked): the registry(name, file) entry of that name, else all whose name holds it in any case."""
    names = asked.select("asked").distinct()
    exact = names.join(registry, F.col("asked") == F.col("name")).select("asked", "name", "file")
    open_ = names.join(exact, "asked", "left_anti").withColumn("b", F.lower("asked")).where("b <> ''")
    low = registry.withColumn("a", F.lower("name"))
    held = holding(low, open_).join(open_, "b").join(low, "a").select("asked", "name", "file")
    return exact.unionByName(held).distinct()


def current_checksums(places: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, function, checksum): eight digits over the lines(file, line, text) of each place, without those that have none."""
    each = places.select("file", "function", "first", "last").distinct().withColumn("line", F.explode(F.sequence("first", "last")))
    held = each.join(lines, ["file", "line"]).groupBy("file", "function", "first").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))  # a function's own
    joined = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    return held.select("file", "function", F.left(F.md5(joined), F.lit(8)).alias("checksum"))


# diffs as lines(diff, pos, value)


def _header() -> Column:
    value = F.col("value")
    return F.when(value.startswith("diff --git"), F.regexp_extract(value, r"^diff --git\s+\S+\s+b?/?(\S+)", 1)).when(value.startswith("+++ "), F.regexp_replace(F.trim(F.substr(value, F.lit(5))), "^b/", ""))


def diff_files(lines: DataFrame, header: Column | None = None) -> DataFrame:
    """lines with `file`, that of the section they stand in: its new name in the header, or in the line with +++."""
    over = Window.partitionBy("diff").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("file", F.last(_header() if header is None else header, ignorenulls=True).over(over))


def diff_of_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The sections of files(file) alone; none where there are no files."""
    return diff_files(lines).join(files.select("file").distinct(), "file", "left_semi").select("diff", "pos", "value")


def diff_of_sources(lines: DataFrame, endings: list[str] | None = None, excluded: list[str] | tuple = ()) -> DataFrame:
    """The sections of files with these endings (SOURCES), but for those in excluded folders."""
    placed = diff_files(lines).where(text.extension(F.col("file")).isin(endings or SOURCES))
    out = reduce(lambda df, p: df.where(~text.has_component(text.folder(F.col("file")), F.lit(p))), excluded, placed)
    return out.select("diff", "pos", "value")


def diff_sizes(lines: DataFrame, least: int = 0) -> DataFrame:
    """(diff, file, size): characters of added and removed lines of each file, those of at least `least`, by size, largest first."""
    value = F.col("value")
    changed = value.rlike("^[+-]") & ~value.rlike(r"^(\+\+\+|---) ")
    short = lines.select("diff", "pos", _header().alias("_h"), F.when(changed, F.length(value)).alias("_n")).where("_h IS NOT NULL OR _n IS NOT NULL")
    size = diff_files(short, F.col("_h")).where("_n IS NOT NULL").groupBy("diff", "file").agg(F.sum("_n").alias("size"))
    return size.where(F.col("size") >= least).orderBy(F.desc("size"), "diff", "file")


# several languages or parts


def united(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Different rows of all parts by keys, each with the names of the parts that have it; columns that a part lacks are null."""
    tagged = [df.select(*[c for c in df.columns if c in keys], F.lit(name).alias("_n")) for name, df in parts.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return every.groupBy(*keys).agg(F.array_sort(F.collect_set("_n")).alias("parts"))  # as many names as there are parts


def outgoing(edges: DataFrame) -> DataFrame:
    """(src, callees) of united edges: each caller's different callees, by name."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("callees"))  # a function's own calls


def united_types(parts: dict[str, DataFrame]) -> DataFrame:
    """(name, places): the types of all parts(name, file, first, last), places of equal names together, each once."""
    every = reduce(lambda a, b: a.unionByName(b), [df.select("name", F.struct("file", "first", "last").alias("p")) for df in parts.values()])
    return every.groupBy("name").agg(F.array_sort(F.collect_set("p")).alias("places"))


def flagged(nodes: DataFrame, flags: DataFrame, name: str) -> DataFrame:
    """nodes(node, ...) with the flag of flags(node, flag), false where there is none."""
    one = flags.groupBy("node").agg(F.bool_or("flag").alias(name))
    return nodes.join(one, "node", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def ordered_by_time(a: Column, b: Column) -> Column:
    """struct(older, newer) of two structs that begin with their time."""
    return F.struct(F.least(a, b).alias("older"), F.greatest(a, b).alias("newer"))
