"""Exact de-duplication by a Golomb-coded fingerprint exchange (operator 9).

Every task that scans texts keeps its rows' 64-bit hashes in sorted chunks and sends each chunk, Rice-coded, to the
owners of hash ranges; the hashes are never shuffled in any other form. Owners answer with one bitmap per chunk that
marks hashes seen more than once. Chunks are stored in buckets, so that bitmaps come to the chunks, which stay where
they are. Only the marked rows' texts are shuffled, and equal bytes decide.

Defined results: null text counts as empty; texts of any length are hashed and compared whole; a null doc_id is
smaller than any other; of repeated rows (same doc_id, same text) exactly one is kept; an empty table gives an empty
result; other columns, whatever their names, are ignored (and kept by keep()).
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

POSITION = 18  # bits of a row's place in its chunk
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code of the gaps of ascending uint64 values: quotient in unary, then k bits."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1 + k)
    bits = np.zeros(int(ends[-1]), np.uint8)
    stops = ends - k - 1
    bits[stops] = 1
    low = gaps & np.uint64((1 << k) - 1)
    for i in range(k):
        bits[stops + 1 + i] = (low >> np.uint64(k - 1 - i)).astype(np.uint8) & 1
    return np.packbits(bits).tobytes()


def rice_decode(data: bytes, n: int, k: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    ones = np.flatnonzero(bits)
    stops = np.empty(n, np.int64)
    at, j = 0, 0
    listed = ones.tolist()
    for i in range(n):  # the next stop bit is the first one-bit at or after `at`
        while listed[j] < at:
            j += 1
        stops[i] = listed[j]
        at = listed[j] + 1 + k
    starts = np.concatenate(([0], stops[:-1] + 1 + k))
    gaps = (stops - starts).astype(np.uint64) << np.uint64(k)
    for i in range(k):
        gaps |= bits[stops + 1 + i].astype(np.uint64) << np.uint64(k - 1 - i)
    return np.cumsum(gaps, dtype=np.uint64)


def rice_parameter(span: int, n: int) -> int:
    return max(0, min(60, int(span // max(n, 1)).bit_length() - 1))


def chunks(rows: DataFrame, owners: int) -> DataFrame:
    """The sorted chunks of each scan task, and their codes, as rows of one table.

    A row of a chunk has its place `uid` (chunk, then position), row, sha and doc_id; a code has its chunk, owner, where
    in the chunk its hashes begin, how many there are, the Rice parameter and the bits.
    """
    doc = rows.schema["doc"].dataType["doc_id"]
    width = (1 << 64) // owners + 1

    def run(batches):
        held, n, chunk = [], 0, 0
        task = TaskContext.get().partitionId()
        schema = None

        def flush():
            table = pa.Table.from_batches(held)
            h = np.array([int.from_bytes(x[:8], "big") for x in table.column("sha").to_pylist()], np.uint64)
            order = np.argsort(h, kind="stable")
            h, own = h[order], (h[order] // np.uint64(width)).astype(np.int64)
            part = task << 20 | chunk
            rows_ = table.take(pa.array(order)).combine_chunks()
            out = {"part": pa.array(np.full(len(h), part)), "uid": pa.array((part << POSITION) + np.arange(len(h))), **{c: rows_.column(c).combine_chunks() for c in rows_.column_names}}
            yield filled(out, len(h))
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            codes = []
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=True):
                k = rice_parameter(width, z - a)
                codes.append((int(own[a]), a, z - a, k, rice_encode(h[a:z] - np.uint64(int(own[a]) * width), k)))
            cols = [pa.array(c) for c in zip(*codes, strict=True)]
            yield filled({"part": pa.array(np.full(len(codes), part)), **dict(zip(("owner", "at", "n", "k", "code"), cols, strict=True))}, len(codes))

        def filled(cols: dict, size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(size, f.type) for f in schema], schema=schema)

        with common.returned():
            for b in batches:
                if schema is None:
                    schema = pa.schema([("part", pa.int64()), ("uid", pa.int64()), ("row", pa.int64()), ("doc_id", b.column("doc_id").type), ("sha", pa.binary()), *((c, pa.int64()) for c in ("owner", "at", "n", "k")), ("code", pa.binary())])
                for at in range(0, b.num_rows, 1 << (POSITION - 1)):
                    some = b.slice(at, 1 << (POSITION - 1))
                    sha = pa.array([hashlib.sha256(t).digest() for t in common.lowered(some)], pa.binary())
                    if n + some.num_rows > 1 << POSITION:
                        yield from flush()
                        held, n, chunk = [], 0, chunk + 1
                    held.append(pa.RecordBatch.from_arrays([some.column("row"), some.column("doc_id"), sha], ["row", "doc_id", "sha"]))
                    n += some.num_rows
            if n:
                yield from flush()

    kind = f"part bigint, uid bigint, row bigint, doc_id {doc.dataType.simpleString()}, sha binary, owner bigint, at bigint, n bigint, k bigint, code binary"
    return rows.select("row", "doc.doc_id", "doc.text").mapInArrow(run, kind)


def answers(codes: DataFrame, owners: int) -> DataFrame:
    """(part, at, n, marks): which hashes of a chunk occur more than once anywhere, where any does."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sent = [rice_decode(r["code"], r["n"], r["k"]) for r in rows]
        values, counts = np.unique(np.concatenate(sent), return_counts=True)
        twice = values[counts > 1]
        hits = [np.isin(c, twice) for c in sent]
        some = [(r["part"], r["at"], r["n"], np.packbits(x).tobytes()) for r, x in zip(rows, hits, strict=True) if x.any()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*some, strict=True) if some else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "at", "n", "marks"])

    return codes.groupBy("owner").applyInArrow(answer, "part bigint, at bigint, n bigint, marks binary")


def marked(prints: DataFrame, maps: DataFrame) -> DataFrame:
    """prints with `hit`, from the bitmaps of each row's chunk."""

    def mark(rows: pa.Table, bits: pa.Table) -> pa.Table:
        hit = np.zeros(1 << POSITION, bool)
        for m in bits.to_pylist():
            hit[m["at"] : m["at"] + m["n"]] = np.unpackbits(np.frombuffer(m["marks"], np.uint8))[: m["n"]]
        place = rows.column("uid").to_numpy() & ((1 << POSITION) - 1)
        return rows.drop_columns(["part"]).append_column("hit", pa.array(hit[place]))

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prints.drop("part").schema.fields) + ", hit boolean"
    return prints.groupBy("part").cogroup(maps.groupBy("part")).applyInArrow(mark, kind)


def grouped(rows: DataFrame) -> DataFrame:
    """One row per row of rows(doc, row): row, doc_id, keep_id, keep_row, group_size, kept, sha."""
    spark = rows.sparkSession
    owners = common.partitions(spark)
    name, path = f"chunks_{uuid.uuid4().hex}", f"{common.shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    with common.small_batches(spark, 500):
        chunks(rows, owners).write.bucketBy(owners, "part").option("path", path).format("parquet").saveAsTable(name)  # so that chunks need no shuffle
    table = spark.table(name)
    maps = answers(table.where("code IS NOT NULL").select("part", "owner", "at", "n", "k", "code"), owners)
    every = common.stored(marked(table.where("code IS NULL").select("part", "uid", "row", "doc_id", "sha"), maps), "marked")
    spark.sql(f"DROP TABLE {name}")
    table.stored_at = path
    common.dropped(table)
    dup = every.where("hit").select("row", "doc_id", "sha")
    few = dup.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS
    body = F.translate(F.coalesce("doc.text", F.lit("")), UPPER, UPPER.lower()).cast("binary").alias("body")
    texts = rows.select("row", body).join(F.broadcast(dup) if few else dup, "row")
    same = texts.groupBy("sha", "body").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")).drop("body")
    sized = same.groupBy("sha").agg(F.count("*").alias("texts"), F.first("group_size").alias("group_size"), F.first("keep").alias("keep"))
    # two different texts under one SHA-256 would make two groups of one hash
    sized = sized.select("sha", "keep", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))).alias("group_size"))
    with common.small_batches(spark, 500):
        sized = common.stored(sized, "groups")
    dup = common.spread_join(dup, sized, ["sha"], "group_size")
    dup = dup.select("row", "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size", (F.col("keep.row") == F.col("row")).alias("kept"), "sha")
    one = every.where("NOT hit").select("row", "doc_id", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return one.unionByName(dup)


def groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = grouped(common.numbered(docs.select("doc_id", "text"), "exact-rows"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the copies: the row with the largest doc_id of each group of equal texts stays, row by row."""
    rows = common.numbered(docs, "exact-rows")
    gone = common.stored(grouped(rows).where("NOT kept").select("row"), "copies")
    return common.semi_by(rows, gone, ["row"], "left_anti").select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return groups(spark, docs)


ORACLE = {
    "op9_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
}
QUERIES = {"op9_exact_dedup": op9_exact_dedup}
