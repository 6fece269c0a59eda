"""Text, JSON and CSV sinks of traces, costs and call trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import traces
from ..plans import scratch


def sliced(df: DataFrame, order: list, slices: int) -> DataFrame:
    """df with `slice`: runs of ceil(n / slices) rows in order."""
    at = scratch.ranked(df, order, "_at", "_all")
    return at.withColumn("slice", F.floor(F.col("_at") / F.ceil(F.col("_all") / slices)).cast("long")).drop("_at", "_all")


def write_sliced(rows: DataFrame, path: str, slices: int) -> None:
    """Traces(trace, frames) as text, one folder a slice, and the number of traces of each beside them."""
    cut = sliced(rows, ["trace"], slices)
    cut.select("slice", F.concat(traces.text_lines(F.col("frames")), F.lit("\n=====")).alias("value")).write.mode("overwrite").partitionBy("slice").text(f"{path}/traces")
    cut.groupBy("slice").agg(F.count("*").alias("traces")).write.mode("overwrite").json(f"{path}/metadata")


def write_costs(costs: DataFrame, path: str, order: Column) -> None:
    """Aggregated costs, highest first, as JSON, CSV and text."""
    rows = costs.orderBy(order)
    rows.write.mode("overwrite").json(f"{path}/json")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in costs.columns]).alias("value")).write.mode("overwrite").text(f"{path}/text")


def tree_text(nodes: DataFrame) -> DataFrame:
    """nodes(root, depth, order, name) as one indented text a root."""
    line = F.struct("order", F.concat(F.repeat(F.lit("  "), F.col("depth")), "name").alias("line"))
    return nodes.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))


def write_conversations(turns: DataFrame, path: str) -> None:
    turns.select("conv_id", "turn", "role", "text").write.mode("append").parquet(path)
