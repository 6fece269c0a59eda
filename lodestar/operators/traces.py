"""Call-stack traces: a row per trace with an array of frames(name, owner, source, cost), the leaf first."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import scratch

#: Names that mark a frame without a function.
UNKNOWN = ("", "???", "<root>", "<unnamed>")
ROWS = 10_000  # of a batch of paths
PATHS = "tree string, leaf int, path array<string>, cost array<bigint>, share array<double>, owner array<string>, source array<string>"


def tree_paths(trees: DataFrame, number: int | None = None) -> DataFrame:
    """trees(tree, body), body a nested profile {frameName, value, ownerName, sourcePath, children[]} as JSON: a row per
    leaf-to-root path, with the number of its leaf, children in order; with `number` that leaf alone. A walk with its own stack,
    so that depth is not bounded by Python's. Paths of many trees go out together, ROWS at most."""

    def walked(root: dict) -> Iterator[tuple]:
        whole = root.get("value") or 0
        stack = [(root, [])]
        while stack:
            node, above = stack.pop()
            here = [(node.get("frameName"), node.get("value") or 0, node.get("ownerName"), node.get("sourcePath")), *above]
            children = node.get("children") or []
            if not children:
                name, cost, owner, source = (list(c) for c in zip(*here, strict=True))
                yield name, cost, [100.0 * c / whole if whole else 0.0 for c in cost], owner, source
            stack.extend((c, here) for c in reversed(children))

    def run(batches):
        kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.string())]
        names = ["tree", "leaf", "path", "cost", "share", "owner", "source"]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for b in batches:
            rows = []
            for tree, body in zip(b.column("tree").to_pylist(), b.column("body").to_pylist(), strict=True):
                for i, p in enumerate(walked(json.loads(body))):
                    if number is None or i == number:
                        rows.append((tree, i, *p))
                    if len(rows) >= ROWS:
                        yield made(rows)
                        rows = []
                    if i == number:
                        break
            if rows:
                yield made(rows)

    return trees.select("tree", "body").mapInArrow(run, PATHS)


ARRAYS = "array<array<struct<path:string,cost:bigint,ownerName:string,sourcePath:string>>>"


def array_frames(docs: DataFrame, json: str) -> DataFrame:
    """docs' other columns with (trace, pos, name, cost, owner, source) of profiles as arrays of arrays of frames in JSON."""
    rest = [c for c in docs.columns if c != json]
    outer = docs.select(*rest, F.posexplode(F.from_json(json, ARRAYS)).alias("trace", "_t"))
    return outer.select(*rest, "trace", F.posexplode("_t").alias("pos", "_f")).select(*rest, "trace", "pos", F.col("_f.path").alias("name"), "_f.cost", F.col("_f.ownerName").alias("owner"), F.col("_f.sourcePath").alias("source"))


def path_at(trees: DataFrame, number: int) -> DataFrame:
    """The path of leaf `number` (from 0) of each tree that has so many."""
    return tree_paths(trees, number)


def of_interest(owner: Column, owners: list[str]) -> Column:
    """Membership; an empty list keeps all."""
    return owner.isin(*owners) if owners else F.lit(True)


def any_owner(frames: Column, owners: list[str]) -> Column:
    """A trace is kept if any frame's owner is in the list; null and empty owners count for nothing."""
    return F.exists(frames, lambda f: F.coalesce((f["owner"] != "") & f["owner"].isin(*owners), F.lit(False))) if owners else F.lit(True)


def any_name(frames: Column, parts: list[str]) -> Column:
    """A trace is kept if any frame's name holds any of the parts."""
    holds = lambda n: F.coalesce(F.greatest(*[F.contains(n, F.lit(p)) for p in parts], F.lit(False)), F.lit(False))
    return F.exists(frames, lambda f: holds(f["name"])) if parts else F.lit(True)


def known_function(name: Column) -> Column:
    return F.coalesce(~F.trim(name).isin(*UNKNOWN), F.lit(False))


def shown_frame(name: Column, root: bool = True) -> Column:
    """Not blank and not ???; `root` says whether <root> is shown."""
    return F.coalesce(~F.trim(name).isin("", "???", *(() if root else ("<root>",))), F.lit(False))


def leaf_cost(frames: Column) -> Column:
    return F.get(frames, F.lit(0))["cost"]


def highest_cost(frames: Column) -> Column:
    return F.array_max(F.transform(frames, lambda f: f["cost"]))


def position_slice(df: DataFrame, order: list, first: float, last: float) -> DataFrame:
    """df without its first and last shares of rows by position."""
    at = scratch.ranked(df, order, "_at", "_all")
    low, high = (F.lit(first) * F.col("_all")).cast("long"), F.col("_all") - (F.lit(last) * F.col("_all")).cast("long")
    return at.where((F.col("_at") >= low) & (F.col("_at") < high)).drop("_at", "_all")


def by_function(frames: DataFrame, keys: list[str], cost: str = "cost") -> DataFrame:
    """keys, cost, frames, and parts per million of the whole, which is one row."""
    out = frames.groupBy(*keys).agg(F.sum(cost).alias("cost"), F.count("*").alias("frames"))
    whole = F.broadcast(out.agg(F.sum("cost").alias("_w")))
    return out.crossJoin(whole).withColumn("ppm", F.when(F.col("_w") > 0, F.floor(F.col("cost") * 1_000_000 / F.col("_w")))).drop("_w")


def liberal(frames: DataFrame) -> DataFrame:
    """By (name, owner): cost, the least source and all sources."""
    return frames.groupBy("name", "owner").agg(F.sum("cost").alias("cost"), F.min("source").alias("source"), F.array_sort(F.collect_set("source")).alias("sources"))


def batch(df: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """Batch `number` (from 0) of `size` rows in order; beyond the end, the last batch there is."""
    n = df.count()
    at = min(number, max(0, (n - 1) // size))
    return df.orderBy(*order).offset(at * size).limit(size)


def first_per_function(frames: DataFrame) -> DataFrame:
    """The traces(trace) that are the first with some function(name)."""
    return frames.groupBy("name").agg(F.min("trace").alias("trace")).select("trace").distinct()


def sampled(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement, all where there are fewer: the first by a seeded hash of the key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(k)


def text_lines(frames: Column) -> Column:
    """A trace as text, one frame a line."""
    return F.array_join(F.transform(frames, lambda f: F.concat_ws(" ", f["owner"], f["name"], F.concat(F.lit("("), f["source"], F.lit(")")), f["cost"].cast("string"))), "\n")
