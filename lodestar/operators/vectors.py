"""A collection of vectors with documents, added to without repeating work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(*parts: str) -> Column:
    return F.left(F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256), F.lit(16))


def to_embed(collection: DataFrame, documents: DataFrame) -> DataFrame:
    """Of documents(id, document, ...) those that collection(id, hash) does not have with the same content, with their hash."""
    new = documents.withColumn("hash", content_hash("document"))
    return new.join(collection.select("id", F.col("hash").alias("_h")), "id", "left").where(~F.col("hash").eqNullSafe(F.col("_h"))).drop("_h")


def upserted(collection: DataFrame, embedded: DataFrame) -> DataFrame:
    """The collection with rows of embedded in place of those of the same id; running it again changes nothing."""
    return collection.join(embedded.select("id"), "id", "left_anti").unionByName(embedded)
