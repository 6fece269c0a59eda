"""The best matching definition of a symbol by shared tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans import scratch

MOST_TOKENS = 6  # of a definition
LONGEST = 10  # tokens of a symbol that count
PIECES = 500_000  # parts of names that a task makes or joins
FEW = 100_000  # names that are broadcast, counted before


def _subsets(tokens: Column, most: int) -> Column:
    """The subsets of one to `most` of the tokens, each in their order."""
    picks = F.filter(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(tokens)) - 1), lambda m: F.bit_count(m) <= most)
    return F.transform(picks, lambda m: F.filter(tokens, lambda _, i: F.call_function("shiftright", m, i).bitwiseAND(1) == 1))


def best_definitions(symbols: DataFrame, definitions: DataFrame) -> DataFrame:
    """(symbol, key, overlap, size) for each of symbols(symbol) that some of definitions(key, place) matches.

    Definitions are gone through by place; one takes the place of the best so far only if it shares more tokens and also
    has more tokens. Definitions of over MOST_TOKENS tokens are left out.

    Only the first definition of each size that shares at least so many tokens with a symbol can ever be taken: had a later
    one of that size been better than the best so far, so would have been the first, and after it the size no longer grows. So each
    subset of a definition's tokens keeps its first definition of each size, a symbol looks up the subsets of its own
    tokens, and the few that come of it are gone through in order. A token that all of them have makes no more rows
    than any other.
    """
    asked = symbols.select("symbol").distinct().select("symbol", F.explode(_subsets(F.array_sort(fn.longest_tokens(F.col("symbol"), LONGEST)), MOST_TOKENS)).alias("part"))
    tokens = F.array_sort(F.array_distinct(fn.symbol_tokens(F.col("key"))))
    known = definitions.select(tokens.alias("tokens"), F.struct("place", "key").alias("first")).where(F.size("tokens").between(1, MOST_TOKENS))
    known = known.groupBy("tokens").agg(F.min("first").alias("first"))  # equal token sets: only the first
    offered = known.select("first", F.size("tokens").alias("size"), F.explode(_subsets(F.col("tokens"), MOST_TOKENS)).alias("part"))
    offered = offered.groupBy("part", "size").agg(F.min("first").alias("first"))
    few = asked.join(offered, "part").groupBy("symbol", F.size("part").alias("overlap"), "size").agg(F.min("first").alias("first"))
    once = few.groupBy("symbol", "first", "size").agg(F.max("overlap").alias("overlap"))  # what it shares is the most it was found by
    ordered = once.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("first", "overlap", "size"))).alias("all"))

    def better(best: Column, x: Column) -> Column:
        return F.when(best.isNull() | ((x["overlap"] > best["overlap"]) & (x["size"] > best["size"])), x).otherwise(best)

    kind = once.select(F.struct("first", "overlap", "size").alias("s")).schema["s"].dataType
    best = ordered.select("symbol", F.aggregate("all", F.lit(None).cast(kind), better).alias("b"))
    return best.select("symbol", F.col("b.first.key").alias("key"), "b.overlap", "b.size")


def found_functions(calls: DataFrame, known: DataFrame) -> DataFrame:
    """calls(name) with the key and the step (1 equal, 2 equal once normalised, 3 one holds the other) of the first of
    known(key, place) that matches, null where none does.

    The third step looks up whole normalised names among each other's parts: of two names one holds the other only if
    the shorter one is a part of the longer, so that pieces are exploded on the side of the longer and compared by
    equality; lengths that occur among the names limit the pieces. Pieces are counted before, and tasks are as many as they need.
    """
    scratch.checkpoints(calls.sparkSession)
    names = calls.select("name").distinct().withColumn("norm", fn.normal_function(fn.bare_function(F.col("name"))))
    known = known.withColumn("norm", fn.normal_function(fn.bare_function(F.col("key"))))
    first = F.min(F.struct("place", "key")).alias("f")
    exact = known.groupBy(F.col("key").alias("name")).agg(first)
    normal = known.groupBy("norm").agg(first).checkpoint()
    got = names.join(exact.hint("merge"), "name", "left").withColumnRenamed("f", "one").join(normal.hint("merge"), "norm", "left").withColumnRenamed("f", "two").checkpoint()
    open_ = got.where("one IS NULL AND two IS NULL AND norm <> ''").select("name", "norm")
    shorter = normal.where("norm <> ''")
    inside = _parts(open_, shorter).select("name", "f")
    held = _parts(shorter.withColumnRenamed("f", "name"), open_.select("norm").distinct()).groupBy("norm").agg(F.min("name").alias("f"))  # the first that holds each part
    around = open_.join(held.hint("merge"), "norm").select("name", "f")
    three = inside.unionByName(around).groupBy("name").agg(F.min("f").alias("three"))
    out = got.join(three.hint("merge"), "name", "left")
    step = F.when(F.col("one").isNotNull(), 1).when(F.col("two").isNotNull(), 2).when(F.col("three").isNotNull(), 3)
    return out.select("name", F.coalesce("one.key", "two.key", "three.key").alias("key"), step.alias("step"))


def _parts(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """shorter(norm, ...) beside the name of each of longer(name, norm) that it is a part of, and not the whole; names and norms are
    unique. The parts of a name of one length are made different in its own row, so that nothing is grouped for it."""
    sizes = F.broadcast(shorter.select(F.length("norm").alias("k")).distinct())  # as many rows as a name has letters
    at = longer.join(sizes, F.length("norm") > F.col("k"))
    pieces = at.agg(F.sum(F.length("norm") - F.col("k") + 1)).first()[0] or 0
    least = scratch.partitions(longer.sparkSession)
    tasks = max(least, -(-pieces // PIECES))
    part = F.transform(F.sequence(F.lit(1), F.length("norm") - F.col("k") + 1), lambda i: F.substr("norm", i, F.col("k")))
    every = at.repartition(tasks, "name", "k").select("name", F.explode(F.array_distinct(part)).alias("norm"))
    if shorter.limit(FEW + 1).count() <= FEW:
        return every.join(F.broadcast(shorter), "norm")
    return every.repartition(tasks, "norm").join(shorter.hint("merge"), "norm")
