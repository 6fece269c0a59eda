"""Document fingerprints by prefix polynomial hashes (operator 2).

A text's prefix arrays hold sums of (code point + 1) * BASE^i modulo two primes. The hash of any span is a
difference of two entries, brought to a common power, so that spans of any texts are compared in constant time
and longest common extensions are found by binary search. An edited text that is put together from spans of known
texts has its arrays without being read again.

A fingerprint is the hash of the whole text and its length, and a sketch of the hashes of all spans of WINDOW
code points: BINS bins by hash, with the least hash of each. The likeness of two fingerprints is 2j / (1 + j) for
the share j of equal bins among those filled in either: the share of spans in common, 1 for equal texts.

The next document is found without sorting all rows in one task: ids are dealt into runs, with a copy of the row
that follows each run.

Defined results: null text counts as empty; texts shorter than WINDOW have one span, empty ones none; two empty
texts have likeness 1; rows sort by doc_id, null first, and repeated ids in any order; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PRIMES = ((2147483647, 1103515245), (2147483629, 1566083941))  # modulus, base
WINDOW = 12
BINS = 64


class Powers:
    """BASE^i for each prime, grown by doubling."""

    def __init__(self):
        self.of = [np.array([1], np.uint64) for _ in PRIMES]
        self.inverse = [np.array([1], np.uint64) for _ in PRIMES]

    def upto(self, n: int) -> list[np.ndarray]:
        for k, (p, b) in enumerate(PRIMES):
            while len(self.of[k]) <= n:
                have = self.of[k]
                self.of[k] = np.concatenate([have, have * np.uint64(pow(b, len(have), p)) % np.uint64(p)])
        return self.of

    def upto_inverse(self, k: int, n: int) -> np.ndarray:
        p, b = PRIMES[k]
        while len(self.inverse[k]) <= n:
            have = self.inverse[k]
            self.inverse[k] = np.concatenate([have, have * np.uint64(pow(b, -len(have), p)) % np.uint64(p)])
        return self.inverse[k]


class Spans:
    """The prefix arrays of one text."""

    def __init__(self, powers: Powers, codes: np.ndarray, sums: list[np.ndarray] | None = None):
        self.powers, self.n = powers, len(codes)
        pw = powers.upto(self.n)
        self.sums = sums if sums is not None else [np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * pw[k][: self.n] % np.uint64(p)) % np.uint64(p))) for k, (p, _) in enumerate(PRIMES)]

    @classmethod
    def joined(cls, one: Spans, a: int, two: Spans, b: int) -> Spans:
        """The first a code points of one, then the first b of two, from their arrays alone."""
        pw = one.powers.upto(a + b)
        sums = []
        for k, (p, _) in enumerate(PRIMES):
            p = np.uint64(p)
            sums.append(np.concatenate((one.sums[k][: a + 1], (one.sums[k][a] + two.sums[k][1 : b + 1] * pw[k][a]) % p)))
        return cls(one.powers, np.zeros(a + b, np.uint64), sums)

    def span(self, a: int, z: int, top: int) -> tuple[int, ...]:
        """The hash of [a, z), brought to the power `top` (at least the start of any span compared with it)."""
        pw = self.powers.upto(top)
        return tuple(int((int(self.sums[k][z]) - int(self.sums[k][a])) % p * int(pw[k][top - a]) % p) for k, (p, _) in enumerate(PRIMES))

    def whole(self) -> tuple[int, ...]:
        return tuple(int(s[self.n]) for s in self.sums)

    def windows(self) -> np.ndarray:
        """Hashes of all spans of WINDOW code points, mixed to 64 bits."""
        w = min(WINDOW, self.n)
        if not w:
            return np.zeros(0, np.uint64)
        top, out = self.n - w, np.zeros(self.n - w + 1, np.uint64)
        for k, (p, _) in enumerate(PRIMES):
            p = np.uint64(p)
            # all spans are brought to the power 0, so that those of different texts can be compared
            inverse = self.powers.upto_inverse(k, top)
            h = (self.sums[k][w:] + p - self.sums[k][: top + 1]) % p * inverse[: top + 1] % p
            out = out * np.uint64(0x9E3779B97F4A7C15) + h
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))

    def sketch(self) -> np.ndarray:
        """The least hash of each bin, its low 16 bits or -1 where the bin is empty."""
        h = self.windows()
        least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, (h >> np.uint64(58)).astype(np.int64), h)
        return np.where(least == np.iinfo(np.uint64).max, -1, (least & np.uint64(0xFFFF)).astype(np.int64))


def equal(one: Spans, a: int, two: Spans, b: int, n: int) -> bool:
    """Whether n code points of one from a and of two from b are the same."""
    top = max(a, b)
    return one.span(a, a + n, top) == two.span(b, b + n, top)


def common_extension(one: Spans, a: int, two: Spans, b: int) -> int:
    """How many code points agree from a in one and b in two onwards."""
    lo, hi = 0, min(one.n - a, two.n - b)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if equal(one, a, two, b, mid):
            lo = mid
        else:
            hi = mid - 1
    return lo


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    filled = (one >= 0) | (two >= 0)
    if not filled.any():
        return 1.0
    j = float((one == two)[filled].mean())
    return 2 * j / (1 + j)


def shown(spans: Spans, sketch: np.ndarray) -> str:
    a, b = spans.whole()
    return f"{spans.n:x}-{a:08x}{b:08x}-" + "".join("----" if v < 0 else f"{v:04x}" for v in sketch)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def compared(docs: DataFrame) -> DataFrame:
    """Each document with its edited text and its successor: the columns of the query."""
    spark = docs.sparkSession
    n = 8 * common.partitions(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), "doc_id", "text")
    ids = docs.select("id")
    ends = ids.agg(F.min("id").alias("a"), F.max("id").alias("z")).first()
    heads = docs.where(F.col("id") == F.lit(ends["a"])).limit(1).select("text").collect() if ends["a"] is not None else []
    first = (heads[0]["text"] or "") if heads else ""  # the successor of the last document
    runs = common.ordered_blocks(ids, docs, "id", n)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_start_next"]

    def run(batches):
        powers = Powers()
        held = None  # (doc_id, text, Spans, sketch, block) that waits for its successor
        made: list = []

        def opened(doc, text, block):
            s = Spans(powers, codes(text))
            return doc, text, s, s.sketch(), block

        def closed(one, two):
            doc, text, s, sk, _ = one
            half = s.n // 2
            took = min(half, two[2].n)
            edited = text[: s.n - half] + two[1][:took]
            e = Spans.joined(s, s.n - half, two[2], took)
            ek = e.sketch()
            made.append((doc, s.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), shown(s, sk), shown(e, ek), 1.0 if s.n == e.n and s.whole() == e.whole() else likeness(sk, ek), likeness(sk, two[3]), common_extension(s, 0, two[2], 0)))

        def batch():
            cols = list(zip(*made, strict=True)) if made else [[] for _ in names]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            types = [b.column("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            for doc, text, block, copy in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "block", "copy")), strict=True):
                if held is not None and held[4] != block:
                    closed(held, opened(None, first, block))  # only the last run has no copy after it
                    held = None
                if copy and held is None:
                    continue
                row = opened(doc, text or "", block)
                if held is not None:
                    closed(held, row)
                held = None if copy else row
            yield batch()
        if held is not None:
            closed(held, opened(None, first, -1))
            yield batch()

    return runs.mapInArrow(common.freeing(run), f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_start_next bigint")


def op2_span_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(common.table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE: dict[str, str] = {}
QUERIES = {"op2_span_fingerprints": op2_span_fingerprints}
