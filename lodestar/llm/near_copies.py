"""Verified shingle similarity for the near-duplicate stage of operator 4.

Multi-index hashing finds what lies within a few bits; texts of similarity 0.8 differ in about ten of 64 bits, for
which Hamming balls are too large. This module verifies the links that hashing finds, and finds the others exactly.

Two rows are linked where the Jaccard similarity of their sets of word shingles is at least SIMILARITY. Shingles are
put in one order, rarer first (by a table of counts; any order is right, a good one keeps keys small). Two sets of
similarity t share one of the first n - ceil(t n) + 1 shingles of each, so only rows that share such a key are compared. The first of the keys that two such sets share
has nothing common before it, so it lies early enough in both for the overlap that they need to follow; pairs of rows whose
places in their sets leave too little behind them are left out before anything is shuffled for them.

Rows of a key are ranked by (size, node). A round compares the next ranks of each key, eight times as many as the one
before, with all ranks behind them, and leaves out pairs that are in one component already. Keys whose rows are all in
one component are dropped before each round, so that a key full of copies, which hashing has joined, costs nothing.

Defined results: null and blank texts have the one shingle of no words; a text shorter than a shingle is one shingle;
texts of any length are compared whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
TABLE = 20  # bits of the table of counts
FIRST = 16  # ranks of each key that the first round compares; every round compares eight times as many


def shingles(text: bytes, width: int) -> np.ndarray:
    """The ascending set of XXH64 of all word shingles."""
    words = text.split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    return np.unique(np.fromiter((digest(joined[a:z], SEED) for a, z in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def needed(n, similarity: float):
    """Least size of an intersection, or of the other set, for a set of n shingles."""
    return np.ceil(similarity * np.asarray(n) - 1e-9).astype(np.int64)


def folded(hashes: np.ndarray) -> int:
    """The SimHash of a set of 64-bit hashes: a bit is set where over half of them have it."""
    ones = sum(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for h in np.array_split(hashes, len(hashes) // 65_536 + 1))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def sets(rows: DataFrame, width: int) -> DataFrame:
    """(node, fp, n, s): fingerprint, size and bytes of the set of each of rows(row, text)."""

    def run(batches):
        with common.returned():
            for b in batches:
                got = [shingles(t, width) for t in common.lowered(b)]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([folded(x) for x in got], pa.int64()), pa.array([len(x) for x in got], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())], ["node", "fp", "n", "s"])

    with common.small_batches(rows.sparkSession):
        return common.stored(rows.select("row", "text").mapInArrow(common.freeing(run), "node bigint, fp bigint, n bigint, s binary"), "shingles")


def counts(nodes: DataFrame) -> np.ndarray:
    """How many sets have a shingle, by the top bits of its hash."""
    cut = 1 << 14

    def run(batches):
        total = np.zeros(1 << TABLE, np.int64)
        for b in batches:
            for s in b.column("s"):
                np.add.at(total, (np.frombuffer(s.as_buffer(), np.uint64) >> np.uint64(64 - TABLE)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(0, 1 << TABLE, cut), pa.int64()), pa.array([total[i : i + cut].tobytes() for i in range(0, 1 << TABLE, cut)])], ["at", "v"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.int64) for v in table.column("v").to_pylist())
        return pa.table({"at": table.column("at")[:1], "v": pa.array([total.tobytes()])})

    with common.small_batches(nodes.sparkSession):
        got = nodes.select("s").mapInArrow(common.freeing(run), "at bigint, v binary").groupBy("at").applyInArrow(add, "at bigint, v binary").collect()
    out = np.zeros(1 << TABLE, np.int64)
    for r in got:
        out[r["at"] : r["at"] + cut] = np.frombuffer(r["v"], np.int64)
    return out


def keys(nodes: DataFrame, similarity: float) -> DataFrame:
    """(key, node, n, place, rank): the prefix of each set, in its order; keys of one node alone are left out."""
    shared = nodes.sparkSession.sparkContext.broadcast(counts(nodes).astype(np.int32))

    def run(batches):
        for b in batches:
            key, node, size, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, n, s in zip(b.column("node").to_pylist(), b.column("n").to_pylist(), b.column("s"), strict=True):
                h = np.frombuffer(s.as_buffer(), np.uint64)
                first = h[np.lexsort((h, shared.value[(h >> np.uint64(64 - TABLE)).astype(np.int64)]))[: n - int(needed(n, similarity)) + 1]]
                key.append(first)
                node.append(np.full(len(first), i))
                size.append(np.full(len(first), n))
                place.append(np.arange(len(first)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(size)), pa.array(np.concatenate(place).astype(np.int32))], ["key", "node", "n", "place"])

    every = nodes.mapInArrow(common.freeing(run), "key bigint, node bigint, n bigint, place int")
    of = Window.partitionBy("key")
    # ranks come first, so that their sort serves the counts too
    ranked = every.withColumn("rank", F.row_number().over(of.orderBy("n", "node")) - 1).withColumn("c", F.count("*").over(of)).where("c > 1")
    with common.small_batches(nodes.sparkSession):
        return common.stored(ranked.select("key", "node", "n", "place", "rank"), "keys")


def overlap(similarity: float) -> Column:
    """How many shingles sets of na and nb must share."""
    return F.ceil(similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9)


def sharing(pairs: DataFrame, key: DataFrame, similarity: float) -> DataFrame:
    """The pairs(a, b, na, nb) that share as many keys as sets with the overlap that they need must share.

    With an overlap of o or more, prefixes of n - o + l shingles have l in common; prefixes here are n - ceil(t n) + 1
    long, so l is the lesser of o - ceil(t n) + 1 for both sets. Only keys are shuffled for it, not sets.
    """
    ours = pairs.join(key.select(F.col("node").alias("a"), "key"), "a").join(key.select(F.col("node").alias("b"), "key"), ["b", "key"])
    least = overlap(similarity) - F.ceil(similarity * F.greatest("na", "nb") - 1e-9) + 1
    return ours.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    pairs = common.stored(pairs, "near-pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = common.semi_by(nodes, used, ["node"])  # only these sets are shuffled
    wide = pairs.join(nodes.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return wide.select("a", "b", "x", "y").mapInArrow(common.freeing(run), "a bigint, b bigint")


def components(nodes: DataFrame, similarity: float, links: DataFrame) -> DataFrame:
    """(node, root) of the nodes that are linked to another; links(a, b) are those that are known."""
    key = keys(nodes, similarity)
    roots = common.stored(common.components(links), "near-roots")
    lo, hi = 0, FIRST
    while True:
        of = Window.partitionBy("key")
        placed = key.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = placed.withColumn("least", F.min("root").over(of)).withColumn("most", F.max("root").over(of)).where("least <> most").drop("least", "most")
        old, key = key, common.stored(placed, "keys")
        common.dropped(old)
        if lo > (key.agg(F.max("rank")).first()[0] or 0):
            break
        front = key.where((F.col("rank") >= lo) & (F.col("rank") < hi)).select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("rank").alias("ra"), F.col("root").alias("ca"))
        behind = key.where(F.col("rank") > lo).select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("rank").alias("rb"), F.col("root").alias("cb"))
        met = front.join(behind, "key").where((F.col("ra") < F.col("rb")) & (F.col("ca") != F.col("cb")) & (F.col("na") >= similarity * F.col("nb") - 1e-9))
        pairs = met.where(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= overlap(similarity)).select("a", "b", "na", "nb").distinct()
        pairs = sharing(pairs, key, similarity)
        with common.small_batches(nodes.sparkSession):
            new = common.stored(verified(pairs, nodes, similarity), "near-links")
        if not new.isEmpty():
            star = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            old, roots = roots, common.stored(common.components(star.unionByName(new)), "near-roots")
            common.dropped(old)
        common.dropped(new)
        lo, hi = hi, hi + 8 * (hi - lo)
    common.dropped(key)
    return roots
