"""Packing tokenized documents into fixed-length sequences by linear grouping (operator 7).

Only the histogram of piece lengths (at most one number per length up to the capacity) reaches the driver. There,
large lengths are rounded up within groups of equal cardinality, configurations of the few rounded sizes are
optimised by column generation, actual lengths are substituted for rounded ones, and what is left, small lengths
above all, is placed best-fit. The plan is a bounded table of (length, ranks) -> (sequences, offset); pieces are
ranked per length and joined to it.

Defined results: null and empty texts are one piece with the end id; texts of any length are encoded whole; repeated
rows are documents of their own; a null doc_id is kept; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
LARGE = 0.1  # of the capacity
GROUPS = 64
RUN = 1 << 20  # bytes of texts that are encoded together; a worker's memory grows with it


def pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = VOCABULARY, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and the end id, cut only where longer than capacity."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        with common.returned():
            code = tokens.encoder(name)
            for b in batches:
                out = ([], [], [], [], [])
                for first, raw, offsets in tokens.runs(b.column("text"), RUN):
                    ids, n = code.encoded(raw, offsets)
                    ends = np.cumsum(n + 1)
                    full = np.full(len(ids) + len(n), end, "<u4")
                    kept = np.ones(len(full), bool)
                    kept[ends - 1] = False
                    full[kept] = ids
                    at = 0
                    for row, to in enumerate(ends.tolist(), first):
                        for i, a in enumerate(range(at, to, capacity)):
                            part = full[a : min(to, a + capacity)]
                            for col, v in zip(out, (row, i, a - at, len(part), zlib.crc32(part)), strict=True):
                                col.append(v)
                        at = to
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# The plan: runs of (lengths in order, how many equal sequences). It knows lengths and counts, never documents.


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 1500) -> list[tuple[tuple[int, ...], float]]:
    """Configurations (items of each size) and how often to use them, by column generation on the covering LP."""
    k = len(sizes)
    size, b = np.array(sizes), np.array(need, float)
    columns = np.diag(capacity // size).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(columns)
        x, price = inverse @ b, inverse.sum(0)
        worth = np.zeros(capacity + 1)
        took = np.full(capacity + 1, -1)
        for c in range(int(size.min()), capacity + 1):
            fits = size <= c
            gain = np.where(fits, worth[np.maximum(c - size, 0)] + price, -1)
            best = int(gain.argmax())
            if gain[best] > worth[c - 1] + 1e-12:
                worth[c], took[c] = gain[best], best
            else:
                worth[c], took[c] = worth[c - 1], -1
        if worth[capacity] <= 1 + 1e-6:
            break
        new, c = np.zeros(k), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                new[took[c]] += 1
                c -= size[took[c]]
        step = inverse @ new
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = new
    x = np.linalg.inv(columns) @ b
    return [(tuple(int(round(v)) for v in columns[:, j]), float(x[j])) for j in range(k) if x[j] > 1e-9]


def grouped(count: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, descending, cut into groups of (nearly) equal cardinality; a length may be shared by neighbours."""
    total = sum(count.values())
    per, out, room = -(-total // groups), [], 0
    for length in sorted(count, reverse=True):
        n = count[length]
        while n:
            if not room:
                out.append([])
                room = per
            out[-1].append((length, t := min(n, room)))
            n, room = n - t, room - t
    return out


def best_fit(count: dict[int, int], bins: dict[int, list], capacity: int) -> list:
    """Runs after placing all of count, longest first, each where it leaves the least room; equal cases go together."""
    for length in sorted((x for x in count if count[x]), reverse=True):
        n = count[length]
        while n:
            room = next((r for r in range(length, capacity) if bins.get(r)), None)
            if room is None:  # open new sequences with as many of this length as fit
                many = min(capacity // length, n)
                new = n // many
                bins[capacity - many * length].append([(length,) * many, new])
                n -= new * many
                continue
            lengths, have = bins[room][-1]
            many = min(room // length, n)
            used = min(have, n // many)
            if used == have:
                bins[room].pop()
            else:
                bins[room][-1] = [lengths, have - used]
            bins[room - many * length].append([lengths + (length,) * many, used])
            n -= used * many
    return [run for runs in bins.values() for run in runs]


def planned(histogram: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths, sequences) that use every length of the histogram exactly as often as it occurs."""
    left = {x: n for x, n in histogram.items() if n and x < capacity}
    big = {x: n for x, n in left.items() if x > large * capacity}
    bins: dict[int, list] = defaultdict(list)
    if big:
        stacks = grouped(big, groups)
        sizes: dict[int, list] = {}
        for g in stacks:  # groups that round to the same size are one
            sizes.setdefault(g[0][0], []).extend(g)
        ordered = sorted(sizes)
        under = dict(zip(ordered, [0, *ordered], strict=False))
        use = configurations(ordered, [sum(n for _, n in sizes[s]) for s in ordered], capacity)
        rest = sorted(left)

        def longest(most: int, taken: dict[int, int]) -> int:
            """The longest length up to `most` of which more is left than these sequences have taken."""
            i = bisect_right(rest, most) - 1
            while i >= 0 and left[rest[i]] <= taken.get(rest[i], 0):
                i -= 1
            return rest[i] if i >= 0 else 0

        for config, times in sorted(use, key=lambda u: (-sum(a * s for a, s in zip(u[0], ordered, strict=True)), u)):
            slots = [s for a, s in zip(config, ordered, strict=True) for _ in range(a)][::-1]
            times = int(times)
            while times > 0:  # equal copies as long as no length runs out
                taken: dict[int, int] = defaultdict(int)
                heads: list[int] = []
                for i, s in enumerate(slots):
                    last = i == len(slots) - 1  # what rounding has left over goes to the last place
                    x = longest(capacity - sum(heads) if last else s, taken)
                    if x <= under[s]:
                        break
                    heads.append(x)
                    taken[x] += 1
                if len(heads) < len(slots):
                    break
                run = min(times, *(left[x] // m for x, m in taken.items()))
                for x, m in taken.items():
                    left[x] -= m * run
                rest = [x for x in rest if left[x]] if any(not left[x] for x in taken) else rest
                bins[capacity - sum(heads)].append([tuple(heads), run])
                times -= run
    out = best_fit(left, bins, capacity)
    if full := histogram.get(capacity, 0):
        out.append([(capacity,), full])
    return [(lengths, n) for lengths, n in out]


def packed(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, name: str = VOCABULARY) -> DataFrame:
    """pieces() with sequence_id and offset."""
    with common.small_batches(spark, 2_000):
        cut = common.stored(pieces(docs, capacity, name).withColumn("_u", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most a row per length
    runs, taken, base = [], defaultdict(int), 0
    for lengths, n in planned(histogram, capacity):
        at = 0
        inside: dict[int, list[int]] = defaultdict(list)
        for x in lengths:
            inside[x].append(at)
            at += x
        for x, offsets in inside.items():  # ranks go round the places of a length in each sequence
            runs.append((x, taken[x], taken[x] + n * len(offsets), base, offsets))
            taken[x] += n * len(offsets)
        base += n
    plan = common.local(spark, runs, "length long, lo long, hi long, base long, at array<long>")
    ranked = common.ranks(cut, "length", ["_u"], "_k")
    k = F.col("_k") - F.col("lo")
    plan = plan.hint("broadcast" if len(runs) <= common.BROADCAST_ROWS else "merge")
    both = ranked.join(plan, (ranked["length"] == plan["length"]) & (F.col("_k") >= F.col("lo")) & (F.col("_k") < F.col("hi"))).drop(plan["length"])
    return both.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.floor(k / F.size("at"))).cast("long").alias("sequence_id"), F.get("at", (k % F.size("at")).cast("int")).alias("offset"))


def pack(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return packed(spark, docs)


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, common.table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE: dict[str, str] = {}
QUERIES = {"op7_pack_sequences": op7_pack_sequences}
