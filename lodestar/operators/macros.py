"""Preprocessor macros of source texts: those that conditions name, and those that they are derived from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import scratch

# Tokens that are no macros.
NO_MACROS = ["defined", "true", "false", "TRUE", "FALSE", "NULL", "nullptr", "if", "else", "elif", "endif", "ifdef", "ifndef", "define", "undef", "include", "pragma", "error", "warning", "line"]

_NAME = "[A-Za-z_][A-Za-z0-9_]*"
_REST = r"\s*(?://|/\*|$)"
_DEFINE = rf"#\s*define\s+({_NAME})\s+(?:!?({_NAME})|!?\(({_NAME})\)){_REST}"
_NAMED = [
    rf"#\s*(?:el)?if\s+defined\s*\(\s*({_NAME})\s*\)",
    rf"#\s*ifn?def\s+({_NAME})",
    rf"#\s*(?:el)?if\s+!?({_NAME}){_REST}",
    rf"#\s*if\s.*?({_NAME})\s*(?:==|!=|>=|<=|>|<)",
]


def _macro(name: Column) -> Column:
    return (F.length(name) > 1) & ~name.startswith("__") & ~name.isin(NO_MACROS)


def named(lines: DataFrame, line: str = "line") -> DataFrame:
    """(macro): each macro that a condition of lines(line) names, once."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in _NAMED]))
    return lines.where(F.col(line).rlike(r"#\s*(if|elif)")).select(F.explode(found).alias("macro")).where(_macro(F.col("macro"))).distinct()


def derived(lines: DataFrame, line: str = "line") -> DataFrame:
    """(macro, base): definitions of a macro by another one, negated or in brackets as well, each once."""
    base = F.concat(F.regexp_extract(line, _DEFINE, 2), F.regexp_extract(line, _DEFINE, 3))
    pair = lines.where(F.col(line).rlike(r"#\s*define\s")).select(F.regexp_extract(line, _DEFINE, 1).alias("macro"), base.alias("base"))
    return pair.where(_macro(F.col("macro")) & _macro(F.col("base"))).distinct()


def closure(definitions: DataFrame, starts: DataFrame) -> DataFrame:
    """(macro, base, steps) of all that each of starts(macro) is derived from, over any number of definitions.

    A round follows one definition from what is new, until nothing is; rings end by themselves. steps is the least.
    Sizes are guessed from compressed files, of which short names fill little, so that joins are told not to broadcast.
    """
    scratch.checkpoints(definitions.sparkSession)
    edges = definitions.select(F.col("macro").alias("_m"), F.col("base").alias("_b")).distinct().checkpoint()
    front = starts.select("macro").distinct().join(edges.hint("merge"), F.col("macro") == F.col("_m")).select("macro", F.col("_b").alias("base"), F.lit(1).alias("steps")).checkpoint()
    seen = front
    steps = 1
    while not front.isEmpty():
        steps += 1
        new = front.join(edges.hint("merge"), F.col("base") == F.col("_m")).select("macro", F.col("_b").alias("base")).distinct().join(seen.hint("merge"), ["macro", "base"], "left_anti")
        front = new.withColumn("steps", F.lit(steps)).checkpoint()
        seen = seen.unionByName(front)
    return seen


def needed(lines: DataFrame, line: str = "line") -> DataFrame:
    """(macro): named macros and both sides of every definition."""
    d = derived(lines, line)
    return named(lines, line).union(d.select("macro")).union(d.select("base")).distinct()
