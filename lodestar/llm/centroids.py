"""Centroid clustering with block-norm screening (operator 13).

Vectors of whole numbers are stored once with the norms of their segments of BLOCK components, rounded down and up. By
Cauchy and Schwarz a segment's part of the squared distance to a centroid is at least the square of the gap between both
norms, so that the gaps of all segments give a lower bound from these few numbers alone, in whole numbers and without
any rounding in its favour. The centroid with the least bound is measured first; only centroids whose bound does not exceed
that distance are measured at all, exactly, so that ties go to the smaller number as without screening.

Each round broadcasts the centroids (a fixed number of vectors), sums vectors per task and cluster, adds those sums up
by cluster and brings one row a cluster to the driver. Vectors themselves never leave their tasks.

Defined results: vectors that are null, of another length or hold a null or non-finite component are left out; a null
vec_id is drawn by `<seed>:` alone; equal ids are ordered by their components and then equal; repeated rows are vectors of
their own; with fewer vectors than centroids there are as many centroids as vectors; an empty table gives an empty
result; other columns are ignored. A component of LARGEST or more in magnitude, whose distances would not fit a long, is an
error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIM = 64
BLOCK = 8
SCALE = 256
SEED = 2
CENTROIDS = 40
ROUNDS = 5
LARGEST = 1 << 27  # of a component in whole numbers


def norms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The norms of the segments of each row, rounded down and up: whole numbers."""
    squares = np.square(x.reshape(len(x), -1, BLOCK)).sum(axis=2)
    down = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    down -= down * down > squares  # a root of a large number may have been rounded
    down += (down + 1) * (down + 1) <= squares
    return down, down + (down * down < squares)


def bounds(down: np.ndarray, up: np.ndarray, c_down: np.ndarray, c_up: np.ndarray) -> np.ndarray:
    """(vectors, centroids): what the squared distance is at least, one segment after the other."""
    out = np.zeros((len(down), len(c_down)), np.int64)
    for s in range(down.shape[1]):
        gap = np.maximum(down[:, s, None] - c_up[None, :, s], c_down[None, :, s] - up[:, s, None])
        np.maximum(gap, 0, out=gap)
        out += gap * gap
    return out


def distances(x: np.ndarray, c: np.ndarray, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of x[rows[i]] to c[to[i]], in pieces of bounded size."""
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 1 << 15):
        some = slice(at, at + (1 << 15))
        out[some] = np.square(x[rows[some]] - c[to[some]]).sum(axis=1)
    return out


def nearest(x: np.ndarray, down: np.ndarray, up: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row, and how many distances were measured."""
    least = bounds(down, up, *norms(c))
    every = np.arange(len(x))
    seed = least.argmin(axis=1)
    found = distances(x, c, every, seed)
    open_ = least <= found[:, None]
    open_[every, seed] = False
    rows, to = np.nonzero(open_)
    best = np.full(least.shape, np.iinfo(np.int64).max)
    best[every, seed] = found
    best[rows, to] = distances(x, c, rows, to)
    cluster = best.argmin(axis=1)  # the first of equal distances
    return cluster, best[every, cluster], len(x) + len(rows)


def whole(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors of dim finite components in whole numbers."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    x = F.transform(v, lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for distances in longs")).cast("long")))
    return embeddings.where(F.coalesce(fine, F.lit(False))).select("vec_id", x.alias("x"))


def compressed(vectors: DataFrame) -> DataFrame:
    """vectors with the norms of their segments: the lower ones and the upper ones."""

    def run(batches):
        for b in batches:
            x = matrix(b.column("x"), DIM)
            down, up = norms(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), listed(down), listed(up)], ["vec_id", "x", "down", "up"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(common.freeing(run), f"vec_id {kind}, x array<bigint>, down array<bigint>, up array<bigint>")


def matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def listed(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64()))


def started(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, DIM)


def summed(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next centroids, from sums per task and cluster, and how many vectors each has."""
    n = len(centroids)

    def run(batches):
        sums, counts = np.zeros((n, DIM), np.int64), np.zeros(n, np.int64)
        for b in batches:
            x = matrix(b.column("x"), DIM)
            cluster, _, _ = nearest(x, matrix(b.column("down"), DIM // BLOCK), matrix(b.column("up"), DIM // BLOCK), centroids)
            np.add.at(sums, cluster, x)
            counts += np.bincount(cluster, minlength=n)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), listed(sums[some])], ["cluster", "n", "s"])

    parts = vectors.mapInArrow(common.freeing(run), "cluster bigint, n bigint, s array<bigint>")
    got = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(DIM)]).collect()  # a row a cluster
    after, counts = centroids.copy(), np.zeros(n, np.int64)
    for r in got:
        counts[r["cluster"]] = r["n"]
        after[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(DIM)]
    return after, counts


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches):
        for b in batches:
            cluster, d, _ = nearest(matrix(b.column("x"), DIM), matrix(b.column("down"), DIM // BLOCK), matrix(b.column("up"), DIM // BLOCK), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(common.freeing(run), f"vec_id {kind}, cluster int, distance bigint")


def clusters(spark: SparkSession, embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids."""
    vectors = common.stored(compressed(whole(embeddings)), "vectors")
    centroids = started(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids, _ = summed(vectors, centroids)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    return assigned(vectors, centroids), centroids


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(spark, common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    found = common.stored(found, "clusters")
    each = found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # a row a cluster
    total = sum(r["d"] for r in each)
    rows = [(r["cluster"], r["d"], total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in each]
    sums = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(sums), "cluster")


def _oracle() -> str:
    """The rounds one after the other; distances to all centroids."""
    parts = [f"""
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS r, vec_id, x FROM (
  SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM})),
c0 AS (SELECT r AS k, x AS c FROM v WHERE r < {CENTROIDS})"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (SELECT r, vec_id, x, k, d FROM (
  SELECT r, vec_id, x, k, d, row_number() OVER (PARTITION BY r ORDER BY d, k) AS n FROM (
    SELECT r, vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i})) WHERE n = 1)""")
        if i < ROUNDS:
            parts.append(f"""
c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
  SELECT k, list(q ORDER BY j) AS c FROM (
    SELECT k, j, ((s - ((s % n) + n) % n) // n)::BIGINT AS q FROM (
      SELECT k, j, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY k, j)) GROUP BY k) m ON m.k = c{i}.k)""")
    return "WITH" + ",".join(parts) + f"""
SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.k"""


ORACLE = {"op13_centroid_clusters": _oracle()}
QUERIES = {"op13_centroid_clusters": op13_centroid_clusters}
