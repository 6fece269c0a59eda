"""Helpers shared by the corpus operators: reading, shared scratch tables, ordered blocks, components."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a side table that may be broadcast; a count is taken before, and a shuffled join is used beyond it.
BROADCAST_ROWS = 1_000_000
#: Links of a node up to which a component round may gather them in one group.
HUB = 100_000


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set, as in tests."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def local(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    """A few rows of the driver as a DataFrame, by Arrow: createDataFrame() of a list starts a second set of Python workers."""
    schema = to_arrow_schema(StructType.fromDDL(kind))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema), kind)


def dropped(df: DataFrame) -> None:
    """Deletes a stored table that nothing will read any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(conf).delete(path, True)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """(doc, row): each row of docs as one struct, so that no name of its columns can clash, and a number that stays
    with the row whenever it is read.

    A plain read of Parquet files needs no copy: the number is the file's and the row's place in it. Anything else
    is written to the shared folder first.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    if not _plain_files(docs):
        return stored(docs.select(doc).withColumn("row", F.monotonically_increasing_id()), name)
    files = docs.select(F.col("_metadata.file_path").alias("file")).distinct()
    files = stored(files.select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("no")), f"{name}-files")
    placed = docs.select(doc, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    few = files.count() <= BROADCAST_ROWS
    return placed.join(F.broadcast(files) if few else files, "file").select("doc", (F.shiftleft("no", 34) + F.col("at")).alias("row"))


def _plain_files(docs: DataFrame) -> bool:
    """Whether docs is a scan of Parquet files with nothing but projections and filters on it."""
    if "_metadata" in docs.columns:
        return False
    try:
        plan = docs._jdf.queryExecution().analyzed()
        while plan.nodeName() in ("Project", "Filter"):
            plan = plan.children().apply(0)
        return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString() and docs.select("_metadata.row_index") is not None
    except Exception:  # noqa: BLE001 - any other kind of plan or session is copied
        return False


def spread_join(left: DataFrame, right: DataFrame, on: list[str], size: str, how: str = "inner") -> DataFrame:
    """left joined to right(on, size, ...), one row per key, where `size` is how many rows of left have the key.

    Keys with over a thousandth of all rows, of which there can be at most a thousand, are broadcast, so that none
    of them makes a large task; the rest is shuffled. how: inner or left.
    """
    total, most = right.agg(F.sum(size), F.max(size)).first()
    if not most or most <= max(1000, total // 1000):
        return left.join(right, on, how)
    hot = F.broadcast(right.where(F.col(size) > max(1000, total // 1000)))
    few = right.where(F.col(size) <= max(1000, total // 1000))
    rest = left.join(hot.select(*on), on, "left_anti")
    return left.join(hot, on).unionByName(rest.join(few, on, how))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def semi_by(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join that broadcasts keys only when their counted rows are few; otherwise both sides are shuffled."""
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if small else keys.hint("merge"), on, how)


def search(bounds: list, key: Column, kind: str) -> Column:
    """How many of the ascending bounds are <= key (a binary search inside the JVM; nulls count as below all)."""
    if not bounds:
        return F.lit(0)
    arr = F.lit(None).cast(f"array<{kind}>") if not bounds else F.array(*[F.lit(b) if not isinstance(b, tuple) else F.struct(*[F.lit(x) for x in b]) for b in bounds]).cast(f"array<{kind}>")
    steps = max(1, math.ceil(math.log2(len(bounds) + 1)))
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"), key.cast(kind).alias("key"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(arr, mid) <= s["key"], F.lit(False)) & (s["lo"] < s["hi"])
        return F.struct(
            F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"),
            s["key"].alias("key"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step, lambda s: s["lo"])


def ordered_blocks(keys: DataFrame, payload: DataFrame, key: str, n: int, *, before: bool = False) -> DataFrame:
    """Deal payload into n runs of the global order of `key` so that each row's neighbour is in its own run.

    keys has the column `key` alone (cheap to scan), payload has it too. Bounds come from the n-quantiles of a
    bounded hash-ordered sample of keys, so memory on the driver is n keys; every run also gets a copy of the
    first row after it (copy = 1), and with before=True of the last row ahead of it (copy = -1). The last run has
    no copy after it. Rows keep all their columns; `block` and `copy` are added and rows are sorted by
    (block, copy, key) within partitions. Rows are never collected in a group: readers stream a run.
    """
    kind = keys.schema[key].dataType.simpleString()
    sample = [r[0] for r in keys.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(16 * n).collect()]
    sample = sorted({tuple(s) if isinstance(s, (tuple, list)) else s for s in sample}, key=_null_first)
    bounds = sorted({sample[i * len(sample) // n] for i in range(1, n)}, key=_null_first) if sample else []
    block = search(bounds, F.col(key), kind)
    edges = keys.groupBy(block.alias("b")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    edges.sort(key=lambda r: r["b"])
    after = {tuple(nxt["lo"]) if isinstance(nxt["lo"], tuple) else nxt["lo"]: cur["b"] for cur, nxt in zip(edges, edges[1:], strict=False)}
    ahead = {tuple(cur["hi"]) if isinstance(cur["hi"], tuple) else cur["hi"]: nxt["b"] for cur, nxt in zip(edges, edges[1:], strict=False)}

    def placed(where: dict, copy: int) -> Column:
        where = {k: b for k, b in where.items() if k is not None}
        if not where:
            return F.lit(None).cast("struct<block:int,copy:int>")
        ks = sorted(where, key=_null_first)
        at = search(ks, F.col(key), kind) - 1
        arr = F.array(*[F.struct(*[F.lit(x) for x in k]) if isinstance(k, tuple) else F.lit(k) for k in ks]).cast(f"array<{kind}>")
        to = F.array(*[F.lit(where[k]) for k in ks])
        return F.when(F.get(arr, at) == F.col(key), F.struct(F.get(to, at).alias("block"), F.lit(copy).alias("copy")))

    places = [F.struct(block.alias("block"), F.lit(0).alias("copy")), placed(after, 1)]
    if before:
        places.append(placed(ahead, -1))
    out = payload.withColumn("_p", F.explode(F.array_compact(F.array(*places))))
    out = out.select("*", F.col("_p.block").alias("block"), F.col("_p.copy").alias("copy")).drop("_p")
    return out.repartition(partitions(keys.sparkSession), "block").sortWithinPartitions("block", "copy", key)


def _null_first(v):
    return tuple((x is not None, x) for x in v) if isinstance(v, tuple) else (v is not None, v)


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for all nodes of links(a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps, which settle in a number of rounds that grows with the square of the
    logarithm of the nodes at most; an error is raised should `rounds` not be enough. Each round replaces links by
    as many or fewer links and is written to the shared folder in place of the one before. Where nodes have over HUB
    links, minima are pre-aggregated before the shuffle and hubs are joined by broadcast.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        settled, most = _shape(edges)
        if settled:
            break
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        read = []
        small = _stars(both) if most <= HUB else _hub_stars(both, read)
        old, edges = edges, stored(small, "links")
        for table in (old, *read):
            dropped(table)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(edges.select("b", "b").distinct())


def _stars(both: DataFrame) -> DataFrame:
    """A large and a small star on links that stand in both directions, where no node has many: one job, nothing stored.

    The large star gives no node more rows than it has links, so the small star's groups are no larger.
    """
    of = Window.partitionBy("a")
    large = both.withColumn("m", F.least(F.min("b").over(of), F.col("a"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return _below(large.withColumn("m", F.min("b").over(of)))


def _hub_stars(both: DataFrame, read: list[DataFrame]) -> DataFrame:
    """_stars() where some nodes have many links: minima are aggregated first and joined, to hubs by broadcast. read gets the tables that it reads."""
    low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "stars")
    large = stored(spread_join(both, low, ["a"], "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "links")
    dropped(low)
    low = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "stars")
    read += [large, low]
    return _below(spread_join(large, low, ["a"], "n"))


def _below(large: DataFrame) -> DataFrame:
    """The small star of links(a, b, m): a and its smaller neighbours b go to m, the least of them."""
    return large.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """Whether links(a, b) with b < a are stars already (every node has one link downwards at most, or only links from
    above), and the most links that a node has."""
    ends = edges.select("a", F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    both = ends.groupBy("a").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    loose, most = both.agg(F.max((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))), F.max(F.col("down") + F.col("up"))).first()
    return not loose, most or 0


def ranks(df: DataFrame, by: str, order: list[str], name: str, per: int = 2_000) -> DataFrame:
    """Adds `name`, a number from 0 within each value of `by` (few values), without one value's rows in one task.

    Each value's rows are cut by a hash of `order` into chunks of about `per` rows; counts of chunks are summed over a
    window (a few rows), then rows are numbered inside their chunk.
    """
    many = df.groupBy(by).agg(F.ceil(F.count("*") / per).alias("_k"))
    few = many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    df = df.join(F.broadcast(many) if few else many, by).withColumn("_c", F.pmod(F.xxhash64(*order), F.col("_k"))).drop("_k")
    counts = df.groupBy(by, "_c").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(F.col(by), F.col("_c"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_s"))
    inside = Window.partitionBy(by, "_c").orderBy(*order)
    out = df.withColumn("_r", F.row_number().over(inside) - 1).join(start, [by, "_c"])
    return out.withColumn(name, (F.col("_s") + F.col("_r")).cast("long")).drop("_c", "_s", "_r")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 100):
    """Around an action: rows that hold long values are read, and come to Python, in batches of few rows."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def few_rows(spark: SparkSession, rows: int = 500) -> None:
    """From here on this session reads Parquet in batches of at most `rows`, for results that are read when they are written.

    Batches of Spark's default size that hold whole texts are arrays of many MB, each of which makes an executor's heap grow.
    """
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


@contextmanager
def returned():
    """Around the work on a partition: memory that it no longer needs goes back to the system, not to the worker's heap."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)


def freeing(run):
    """A function of batches for mapInArrow, with returned() around the work on its partition."""

    def wrapped(batches):
        with returned():
            yield from run(batches)

    return wrapped


def lowered(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 of a text column with A-Z lowered and nothing else; null counts as empty."""
    col = batch.column(name).cast(pa.binary())
    return [(v or b"").lower() for v in col.to_pylist()]
