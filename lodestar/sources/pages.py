"""Reading a database table page by page, all pages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import scratch

PAGE = 1_000


def page_starts(spark: SparkSession, url: str, name: str, key: str, page: int = PAGE, **options: str) -> list:
    """The key at which each page begins, from the database's own numbering: one row a page comes back, not the keys."""
    ordered = f"SELECT {key} AS k FROM {name} WHERE {key} IS NOT NULL ORDER BY {key}"
    numbered = f"(SELECT * FROM (SELECT o.k AS k, ROW_NUMBER() OVER () AS n FROM ({ordered}) o) p WHERE MOD(p.n - 1, {page}) = 0) q"
    rows = spark.read.format("jdbc").option("url", url).option("dbtable", numbered).options(**options).load().collect()
    return sorted({r[0] for r in rows})


def _literal(v) -> str:
    return str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"


def paged(spark: SparkSession, url: str, name: str, key: str, page: int = PAGE, quote: str = '"', **options: str) -> DataFrame:
    """Every row of a table once, in partitions of about `page` rows that are read at the same time.

    Pages are ranges of the key and not offsets: no page makes the database go through the ones before, and a row that
    comes or goes meanwhile moves no other to another page. Rows of one key stay in one page; rows without a key make the first.
    """
    key = f"{quote}{key}{quote}"
    starts = page_starts(spark, url, name, key, page, **options)
    if len(starts) < 2:
        ranges = [f"{key} IS NULL OR {key} IS NOT NULL"]
    else:
        ranges = [f"{key} IS NULL OR {key} < {_literal(starts[1])}"]
        ranges += [f"{key} >= {_literal(a)} AND {key} < {_literal(z)}" for a, z in zip(starts[1:], starts[2:], strict=False)]
        ranges.append(f"{key} >= {_literal(starts[-1])}")
    return spark.read.jdbc(url, name, predicates=ranges, properties=options)


def numbered(table: DataFrame, key: str, page: int = PAGE) -> DataFrame:
    """table with `page`, from 0 in the key's order, for tables in storage that all executors share.

    Pages have about `page` rows. As in paged(), rows of one key stay in one page and rows without a key come first.
    """
    at = scratch.ranked(table, [F.asc_nulls_first(key)], "_at")
    first = F.min("_at").over(Window.partitionBy(key))
    return at.withColumn("page", F.floor(first / page)).drop("_at")
