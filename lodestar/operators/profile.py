"""Cost attribution over profile trees and comparison of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import scratch


def inclusive(frames: DataFrame) -> DataFrame:
    """frames(node, parent, own) with `total`, the cost of the subtree, of a tree of any depth.

    Costs climb one level a round, summed by the node that they reach, so that a round handles a row for each node that
    has something below it and reads nothing that earlier rounds have read; then all sums of a node are added up once.
    """
    scratch.checkpoints(frames.sparkSession)
    up = frames.where("parent IS NOT NULL").select("node", "parent").checkpoint()
    costs = frames.select("node", F.col("own").alias("_c")).checkpoint()
    out, front = costs, costs
    while True:
        front = front.join(up, "node").groupBy(F.col("parent").alias("node")).agg(F.sum("_c").alias("_c")).checkpoint()
        if front.isEmpty():
            break
        out = out.unionByName(front)
    total = out.groupBy("node").agg(F.sum("_c").alias("total"))
    return frames.join(total, "node")


def self_cost(frames: DataFrame) -> DataFrame:
    """frames(node, parent, total) with self = total less the children's totals."""
    below = frames.groupBy(F.col("parent").alias("node")).agg(F.sum("total").alias("_s"))
    return frames.join(below, "node", "left").withColumn("self", F.col("total") - F.coalesce("_s", F.lit(0))).drop("_s")


def by_key(costs: DataFrame, keys: list[str], **sums: str) -> DataFrame:
    return costs.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()], F.count("*").alias("frames"))


def with_share(costs: DataFrame, cost: str, share: str = "share") -> DataFrame:
    """Share of the total, which is one row that the engine broadcasts; null where the total is not positive."""
    total = costs.agg(F.sum(cost).alias("_t"))
    return costs.crossJoin(F.broadcast(total)).withColumn(share, F.when(F.col("_t") > 0, F.col(cost) / F.col("_t"))).drop("_t")


def compared(a: DataFrame, b: DataFrame, keys: list[str], cost: str) -> DataFrame:
    """Both profiles by key: cost_a, cost_b, delta and status (both, only_a, only_b)."""
    x, y = a.select(*keys, F.col(cost).alias("cost_a")), b.select(*keys, F.col(cost).alias("cost_b"))
    status = F.when(F.col("cost_b").isNull(), "only_a").when(F.col("cost_a").isNull(), "only_b").otherwise("both")
    return x.join(y, keys, "full_outer").withColumn("status", status).withColumn("delta", F.coalesce("cost_b", F.lit(0)) - F.coalesce("cost_a", F.lit(0)))


def worth_keeping(self_share: Column, total_share: Column, least_self: float = 1e-4, least_total: float = 1e-2) -> Column:
    return (self_share >= least_self) | (total_share >= least_total)
