"""Search in JSON of any shape and depth, without a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import scratch

LEVELS = 12  # that a round opens before what is found and left is stored


def values_of(docs: DataFrame, json: str, wanted: str) -> DataFrame:
    """docs' other columns, path and value (as JSON) of each value that stands under the key `wanted`, at any depth.

    A round opens every object and array that is left, LEVELS deep and without a shuffle; rounds go on until nothing can be
    opened, so that depth has no bound. Found values go along as rows with nothing left to open, and are themselves searched
    further by a row of their own. Broken JSON has no values.
    """
    scratch.checkpoints(docs.sparkSession)
    tvf = docs.sparkSession.tvf
    rest = [c for c in docs.columns if c != json]
    none, gone = F.lit(None).cast("string"), F.lit(None).cast("variant")
    front = docs.select(*rest, F.lit("$").alias("path"), none.alias("_h"), F.try_parse_json(json).alias("_v")).where("_v IS NOT NULL")
    step = F.when(F.col("pos").isNull(), "").when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    here = F.struct(F.col("_h"), F.col("value").alias("_v"))
    both = F.array(here, F.struct(F.to_json("value").alias("_h"), gone.alias("_v")))
    out = None
    while True:
        for _ in range(LEVELS):
            inner = front.lateralJoin(tvf.variant_explode_outer(F.col("_v").outer())).where("_h IS NOT NULL OR pos IS NOT NULL")
            inner = inner.select(*rest, F.concat("path", step).alias("path"), F.explode(F.when(F.col("key") == wanted, both).otherwise(F.array(here))).alias("_x"))
            front = inner.select(*rest, "path", "_x._h", "_x._v")
        inner = front.where("_h IS NOT NULL" + "".join(f" OR try_variant_get(_v, '$', '{kind}') IS NOT NULL" for kind in ("map<string,variant>", "array<variant>"))).checkpoint()
        hits = inner.where("_h IS NOT NULL").select(*rest, "path", F.col("_h").alias("value"))
        out = hits if out is None else out.unionByName(hits)
        front = inner.where("_h IS NULL")
        if front.isEmpty():
            return out
