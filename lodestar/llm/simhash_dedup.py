"""SimHash near-duplicates by multi-index hashing (operator 4).

A 64-bit fingerprint is cut into three segments (21, 21 and 22 bits). Two fingerprints within four bits differ by
at most one bit in the first or the second segment, or agree on the third (otherwise they would differ by
2 + 2 + 1 bits). So the tables of segments one and two are probed with Hamming balls of radius one, the third with
the exact value, and full distances are verified. A ball is halved by symmetry: of two segments that differ in
one bit, the one with a zero there probes for the other.

Rows that share a table key are adjacent after a sort by that key. Within a key, links are found by expanding one
component after another, so a key with g fingerprints yields at most g - 1 links, never all pairs; the components
are those of all links. Equal fingerprints are one node. A key of over CROWDED fingerprints is cut by the other bits:
they fall into five parts, of which two fingerprints within four bits share one, so no key grows with the corpus.

The pipeline's stage (keep) uses five words, verifies every link by the similarity of the shingle sets, and lets
near_copies find the links of similarity SIMILARITY that lie further apart than four bits.

Defined results: null text counts as empty; empty texts have fingerprint zero and are linked like any other; texts of
any length are hashed whole; repeated rows each get a result row; a null doc_id is never the smallest of a component
with another id; an empty table gives an empty result; other columns, whatever their names, are ignored (and kept by
keep()).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, near_copies

SEGMENTS = ((43, 21, 1), (22, 21, 1), (0, 22, 0))  # lowest bit, bits, radius; sum of (radius + 1) = DISTANCE + 1
DISTANCE = 4
SEED = 42
CHUNK = 1 << 16  # hashes whose bits are counted at once
CROWDED = 4_096  # fingerprints of a key from which it is cut further
DENSE = 256  # members of a key from which components are expanded instead of comparing neighbours


def simhash(text: bytes, shingle: int) -> int:
    """Bit set where over half of the XXH64 of all word shingles, repeats included, have it set."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        h = np.array([digest(joined[a:z], SEED) for a, z in zip(starts[i : i + CHUNK], ends[i : i + CHUNK], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit integer."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = np.array([simhash(t, shingle) for t in common.lowered(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(common.freeing(run), f"doc_id {kind}, fp bigint")


def own_keys(fp: np.ndarray, t: int) -> np.ndarray:
    low, width, _ = SEGMENTS[t]
    return ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)) | np.uint64(t << 24)


def probes(nodes: DataFrame, crowded: set[int] | None = None) -> DataFrame:
    """(key, probe, fp) for nodes(fp): each fingerprint's own key in each table, and the upper half of its balls.

    Rows of a crowded key come once for each of the five parts of the bits outside its segment, under keys of their own.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(np.array(sorted(crowded or ()), np.uint64))

    def cut(t: int, key: np.ndarray, fp: np.ndarray):
        low, width, _ = SEGMENTS[t]
        rest = ((fp >> np.uint64(low + width)) << np.uint64(low) if low + width < 64 else np.zeros_like(fp)) | (fp & np.uint64((1 << low) - 1))
        size = -(-(64 - width) // (DISTANCE + 1))
        for i in range(DISTANCE + 1):
            yield key << np.uint64(32) | np.uint64((i + 1) << 24) | (rest >> np.uint64(i * size)) & np.uint64((1 << size) - 1)

    def run(batches):
        full = shared.value
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for t, (_, width, radius) in enumerate(SEGMENTS):
                own = own_keys(fp, t)
                for flip in range(-1, width if radius else 0):
                    mask = np.ones(len(fp), bool) if flip < 0 else (own >> np.uint64(flip)) & np.uint64(1) == 0
                    key = own[mask] | np.uint64(0 if flip < 0 else 1 << flip)
                    deep = np.isin(key, full)
                    for k, f in ((key[~deep] << np.uint64(32), fp[mask][~deep]), *((k, fp[mask][deep]) for k in cut(t, key[deep], fp[mask][deep]) if deep.any())):
                        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.full(len(k), flip >= 0)), pa.array(f.view(np.int64))], ["key", "probe", "fp"])

    return nodes.mapInArrow(common.freeing(run), "key bigint, probe boolean, fp bigint")


def crowded_keys(nodes: DataFrame, most: int) -> set[int]:
    """Keys with over `most` fingerprints, and those within a bit of them; there are at most 3 * 2^22 keys at all."""

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own_keys(fp, t) for t in range(len(SEGMENTS))]).astype(np.int64))], ["key"])

    full = [r["key"] for r in nodes.select("fp").mapInArrow(common.freeing(run), "key bigint").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key").collect()]
    return {k ^ flip for k in full for flip in (0, *(1 << i for i in range(SEGMENTS[k >> 24][1])))}


def key_links(key: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Verified links (n, 2) within runs of equal keys, members that own the key first."""
    found = [np.zeros((0, 2), np.uint64)]
    cuts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    sizes = np.diff(cuts, append=len(key))
    dense = np.repeat(sizes > DENSE, sizes)
    for d in range(1, int(sizes[sizes <= DENSE].max(initial=1))):
        i = np.flatnonzero((key[:-d] == key[d:]) & ~probe[:-d] & ~dense[:-d])
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= DISTANCE]
        found.append(np.stack([fp[i], fp[i + d]], 1))
    for a, n in zip(cuts[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist(), strict=True):
        rest = np.unique(fp[a : a + n])
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                at = front.pop()
                near = np.bitwise_count(rest ^ at) <= DISTANCE
                new, rest = rest[near], rest[~near]
                found.append(np.stack([np.full(len(new), at), new], 1))
                front.extend(new)
    return np.concatenate(found)


def links(nodes: DataFrame, most: int = CROWDED) -> DataFrame:
    """Links (a, b) between different fingerprints whose components are those of all links within DISTANCE."""
    crowded = crowded_keys(nodes, most)

    def run(batches):
        held: list[pa.RecordBatch] = []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = up = parent[up]
                x = up
            return x

        def flush(table: pa.Table):
            key, probe, fp = (table.column(c).to_numpy(zero_copy_only=False) for c in ("key", "probe", "fp"))
            out = []
            for a, b in key_links(key, probe.astype(bool), fp.astype(np.int64).view(np.uint64)).tolist():
                x, y = root(a), root(b)
                if x != y:  # links inside what this task has joined already add nothing
                    parent[x] = y
                    out.append((a, b))
            got = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            key = b.column("key")
            last = key[b.num_rows - 1].as_py()
            if sum(x.num_rows for x in held) < 200_000 or key[0].as_py() == last:
                continue
            table = pa.Table.from_batches(held)
            n = int(np.searchsorted(table.column("key").to_numpy(), last))  # the last key may go on in the next batch
            yield flush(table.slice(0, n))
            held = table.slice(n).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    spark = nodes.sparkSession
    return probes(nodes, crowded).repartition(common.partitions(spark), "key").sortWithinPartitions("key", "probe").mapInArrow(common.freeing(run), "a bigint, b bigint")


def classes(docs: DataFrame, shingle: int = 4, most: int = CROWDED) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    prints = common.stored(fingerprints(docs, shingle), "simhash")
    nodes = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "nodes")
    tied = common.components(links(nodes.select("fp"), most))
    low = tied.join(nodes, tied["node"] == nodes["fp"]).select("node", "root", "low")
    least = low.groupBy("root").agg(F.min("low").alias("least"))
    of = nodes.join(low.join(least, "root").select(F.col("node").alias("fp"), "least"), "fp", "left")
    of = common.stored(of.where("n > 1 OR least IS NOT NULL").select("fp", "n", F.coalesce("least", "low").alias("component_id")), "classes")
    out = common.spread_join(prints, of, ["fp"], "n", "left")
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def similar(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root): components of rows(row, text) whose sets of shingles are linked at this similarity or more.

    Links within DISTANCE bits come first, by multi-index hashing; each is verified by the sets. They join nearly all
    copies, so that the exact search for the rest has few pairs left to compare.
    """
    each = near_copies.sets(rows, shingle)
    of = common.stored(each.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "near-prints")
    same = common.spread_join(each.select("fp", "node"), of.where("n > 1"), ["fp"], "n").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(of.select("fp"))
    near = near.join(of.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    near = same.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()
    with common.small_batches(rows.sparkSession):
        near = common.stored(near_copies.verified(near, each, similarity), "near-links")
    return near_copies.components(each, similarity, near)


def keep(spark: SparkSession, docs: DataFrame, shingle: int = near_copies.SHINGLE, similarity: float = near_copies.SIMILARITY) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id (of rows without id only where all are)."""
    rows = common.numbered(docs, "near-rows")
    tied = similar(rows.select("row", "doc.text"), shingle, similarity)
    placed = rows.select("row", F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), "row").alias("k"))
    placed = common.stored(common.semi_by(placed, tied.select(F.col("node").alias("row")), ["row"]).join(tied.withColumnRenamed("node", "row"), "row"), "near-placed")
    least = placed.groupBy("root").agg(F.min("k").alias("k"), F.count("*").alias("n")).select("root", "n", F.col("k.row").alias("kept"))
    gone = common.stored(common.spread_join(placed, least, ["root"], "n").where("row <> kept").select("row"), "near-copies")
    return common.semi_by(rows, gone, ["row"], "left_anti").select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op4_simhash_dedup": op4_simhash_dedup}
