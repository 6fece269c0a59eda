"""Mixing sources to target weights by a low-discrepancy schedule (operator 3).

Slot i of the mixture takes the i-th point of the golden-ratio sequence, which falls into one source's share of
the cumulative weights. The slots of a source are ranked, and the rank names a block of equally many words in the
source's shuffled stream of documents (each at most `epochs` times). Joining slots and blocks gives the mixture:
pieces of documents in slot order. A source's count of slots differs from its share by a few at any length.

Ranks and stream positions are two-level sums (per chunk, then inside it), so that no source is gathered in one
task. All draws are hashes of a seed and a document's own id, source and text, so reruns agree, however the rows are
laid out in files; only rows that are equal in all three can change places.

Defined results: null or empty text has size 0 and takes nothing; texts of any length are counted whole; sources sort
by code point, null last; a null doc_id is an id like any other; repeated rows are documents of their own; an empty
table gives an empty result; other columns, whatever their names, are ignored (and kept by keep()).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK = 128  # words
PERIOD = 1 << 31
STEP = 1327217885  # PERIOD / golden ratio, odd
CHUNK_SLOTS = 1 << 14


def targets(sizes: dict, cycle=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> dict:
    """Words to take from each source; sizes in source order. The excess over cap x size goes to the others by weight."""
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(sizes)}
    total, out, free = share * sum(sizes.values()), {}, dict(sizes)
    left = min(total, cap * sum(sizes.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            del free[s]
    return out


def stream(sized: DataFrame, seed: int, per: int = 2_000) -> DataFrame:
    """sized(row, key, src, size, of) with `at`: the words ahead of the document in its source's shuffled stream.

    key is a hash of the document itself; `of` is how many documents its source has.
    """
    sized = sized.withColumn("_h", F.xxhash64("key", F.lit(seed))).withColumn("_c", F.pmod(F.shiftright("_h", 8), F.ceil(F.col("of") / per)))
    sums = sized.groupBy("src", "_c").agg(F.sum("size").alias("_n"))
    ahead = Window.partitionBy("src").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "_c", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_s"))
    inside = Window.partitionBy("src", "_c").orderBy("_h", "key", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.withColumn("_r", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["src", "_c"])
    return out.withColumn("at", F.col("_s") + F.col("_r")).drop("_h", "_c", "_s", "_r", "key", "of")


def schedule(spark: SparkSession, goal: list[float], block: int) -> DataFrame:
    """(slot, src, rank) for sources 0..n-1 whose goals are words: golden-ratio points ranked per source."""
    total = sum(goal)
    n = math.ceil(total / block)
    cuts, run = [], 0.0
    for g in goal[:-1]:
        run += g
        cuts.append(run / total)
    # slot / golden ratio modulo one, in units of 2^-31; the sequence visits every unit once before it repeats
    point = ((F.col("id") % PERIOD) * STEP % PERIOD).cast("double") / PERIOD
    src = common.search(cuts, point, "double") if cuts else F.lit(0)
    slots = spark.range(n).select(F.col("id").alias("slot"), src.cast("int").alias("src"), (F.col("id") / CHUNK_SLOTS).cast("long").alias("c"))
    counts = slots.groupBy("src", "c").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("src").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("src", "c", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("s"))
    inside = Window.partitionBy("src", "c").orderBy("slot")
    return slots.withColumn("r", F.row_number().over(inside) - 1).join(counts, ["src", "c"]).select("slot", "src", (F.col("s") + F.col("r")).alias("rank"))


def mixture(spark: SparkSession, docs: DataFrame, *, cycle=(3.0, 1.0, 2.0), share: float = 1.5, cap: int = 2, block: int = BLOCK, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents: row, doc_id, source, size, source_size, target; pieces: slot, row, epoch, first, words).

    first and words say which words of the document the slot takes, in its epoch-th use. `row` numbers the rows of
    docs as common.numbered does.
    """
    return _mixed(spark, common.numbered(docs, "mixing-rows"), cycle, share, cap, block, seed)


def _mixed(spark: SparkSession, docs: DataFrame, cycle, share: float, cap: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(
        "row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), F.coalesce(F.regexp_count("doc.text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc.doc_id", "doc.source", "doc.text").alias("key"),
    )
    with common.small_batches(spark, 500):
        rows = common.stored(rows, "sizes")
    by = {r["source"]: (r["n"], r["of"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("of")).collect()}  # a row per source
    names = sorted(by, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    goal = targets({s: by[s][0] for s in names}, cycle, share, float(cap))
    kind = "_source string, src int, source_size long, target double, of long"
    known = common.local(spark, [(s, i, int(by[s][0]), float(goal[s]), by[s][1]) for i, s in enumerate(names)], kind)
    known = known.hint("broadcast" if len(names) <= 10_000 else "merge")
    rows = rows.join(known, rows["source"].eqNullSafe(known["_source"])).drop("_source")
    if not sum(goal.values()):
        none = common.local(spark, [], "slot long, row long, epoch int, first long, words long")
        return rows, none
    lone = stream(rows.where("size > 0").select("row", "key", "src", "size", "source_size", "of"), seed)
    lone = lone.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    lone = lone.withColumn("at", F.col("at") + F.col("epoch") * F.col("source_size"))
    lone = lone.withColumn("rank", F.explode(F.sequence((F.col("at") / block).cast("long"), ((F.col("at") + F.col("size") - 1) / block).cast("long"))))
    slots = schedule(spark, [goal[s] for s in names], block)
    both = lone.join(slots, ["src", "rank"])
    first = F.greatest(F.col("rank") * block - F.col("at"), F.lit(0))
    last = F.least((F.col("rank") + 1) * block - F.col("at"), F.col("size"))
    return rows, both.select("slot", "row", "epoch", first.alias("first"), (last - first).alias("words"))


def keep(spark: SparkSession, docs: DataFrame, *, cycle=(3.0, 1.0, 2.0), share: float = 1.5, cap: int = 2, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """docs as the mixture takes them: a row per document and use, with the text cut to the words taken."""
    keyed = common.numbered(docs, "mixed")
    rows, pieces = _mixed(spark, keyed, cycle, share, cap, block, seed)
    spans = pieces.groupBy("row", "epoch").agg(F.min("first").alias("a"), F.max(F.col("first") + F.col("words")).alias("z"))
    spans = spans.join(rows.select("row", "size"), "row").select("row", "a", "z", "size")
    out = keyed.join(spans, "row")
    words = F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), 0), F.col("a").cast("int") + 1, (F.col("z") - F.col("a")).cast("int"))
    cut = (F.col("z") - F.col("a")) < F.col("size")
    text = F.when(cut, F.array_join(words, " ")).otherwise(F.col("doc.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.char_length(text).cast("long")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "source", "text")
    rows, pieces = mixture(spark, docs)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


ORACLE: dict[str, str] = {}
QUERIES = {"op3_mix_sources": op3_mix_sources}
