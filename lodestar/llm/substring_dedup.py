"""Substring de-duplication with a compressed FM-index per shard (operator 11).

Words covered by a window of WINDOW consecutive words that also starts in a document with a smaller doc_id are removed.

Shards. Each window belongs to the GRAM-word run of least hash in it; consecutive windows with one such key make a segment,
which is a few words longer than the windows that begin in it. Equal windows have equal keys, so that segments of one
key, and of many keys, can be searched by themselves: a shard's index never has to see other text, and the work grows
with the text and not with its square.

1. A scan sends each task's different keys; a sum by key leaves those of more than one document. They fill a Bloom filter
   of at most FILTER_BYTES, which is broadcast. Were it too small, more segments than need be would be searched, with
   the same result.
2. A scan sends the segments whose keys pass, equal ones of a run of documents as one, with the least doc_id. They are
   dealt to shards of about SHARD_WORDS words.
3. A shard indexes its segments (those of a key that has more than one): words become numbers, suffixes are sorted, and the
   Burrows-Wheeler transform is kept in a Huffman-shaped wavelet tree of packed bits with counts every 64 bits. All its
   segments stream through it, backwards from the end of each window: the matching statistic of a place is how many
   words back a match goes that is found in more than one place. Where it reaches WINDOW, the least doc_id of the matches is
   compared with the segment's own.
4. A third scan finds the places of segments that are equal to others or have such windows (by a filter again, then a join),
   and each document's places meet its text.

A key with over CROWDED different segments (a frequent phrase between other words) would make one large index. Its segments
are cut into single windows, which are dealt by their own hashes: equal ones meet as equal segments do, and need no
index. Which keys these are is also told by a filter; a key that it takes for crowded is found just as well.

Defined results: null text has no words; texts of any length are read whole; a null doc_id is smaller than any other,
and rows of one doc_id (or of none) are no copies of each other; texts of fewer than WINDOW words lose nothing; an empty table
gives an empty result; other columns, whatever their names, are ignored. doc_id is read as a long. Segments meet by two
64-bit polynomial hashes over two hashes of their words; inside an index words are compared themselves.
"""

from __future__ import annotations

import heapq
import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
GRAM = 5
FILTER_BYTES = 32 << 20
FILTER_BITS = 16  # of the filter a key, while there is room
SHARD_WORDS = 150_000
CROWDED = 1_000
CHUNK_BYTES = 1 << 20  # of texts that a task works on at once; a longer text is a chunk of its own
_RUN = WINDOW - GRAM + 1  # windows that may share one place of their key
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Numbers(dict):
    """Numbers from 1 on, in the order in which words come up."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class Powers:
    """What hashes of words and of spans of words are multiplied by, grown as texts need it."""

    def __init__(self):
        self.bytes = [np.ones(1, np.uint64) for _ in _BASES]
        self.words = [np.ones(1, np.uint64) for _ in _BASES]
        self.inverse = [np.ones(1, np.uint64) for _ in _BASES]

    def upto(self, letters: int, words: int) -> None:
        for k, b in enumerate(_BASES):
            for row, base, n in ((self.bytes, b ^ 0x5851F42D4C957F2C, letters), (self.words, b, words), (self.inverse, pow(b, -1, 1 << 64), words)):
                while len(row[k]) <= n:
                    row[k] = np.concatenate((row[k], row[k] * np.uint64(pow(base, len(row[k]), 1 << 64))))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Chunk:
    """The segments of some texts: doc (of texts), start (in the chunk's words), windows, key, and the hashes of spans.

    Words are found and hashed in the bytes of all texts at once.
    """

    def __init__(self, powers: Powers, texts: list[bytes]):
        self.flat = b"\n".join([*texts, b""])
        raw = np.frombuffer(self.flat, np.uint8)
        space = _SPACE[raw]
        inside = np.flatnonzero(~space)
        turn = np.flatnonzero(np.diff(inside, prepend=-2) > 1)  # in inside: where words begin
        self.begin = inside[turn]
        letters = np.diff(turn, append=len(inside))
        self.end = self.begin + letters
        total = len(turn)
        of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.begin, side="right")
        sizes = np.bincount(of, minlength=len(texts))
        self.first = np.cumsum(sizes) - sizes
        powers.upto(int(letters.max(initial=0)), total)
        self.powers, byte = powers, raw[inside].astype(np.uint64) + np.uint64(1)
        at = np.arange(len(inside)) - np.repeat(turn, letters)
        h = [mixed(np.add.reduceat(byte * p[at], turn)) if total else np.zeros(0, np.uint64) for p in powers.bytes]
        self.prefix = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * p[: len(x)], dtype=np.uint64))) for x, p in zip(h, powers.words, strict=True)]
        windows = np.maximum(sizes - WINDOW + 1, 0)
        of = np.repeat(np.arange(len(texts)), windows)
        place = np.arange(len(of)) + np.repeat(self.first - (np.cumsum(windows) - windows), windows)
        grams = np.zeros(max(0, total - GRAM + 1), np.uint64)
        for j in range(GRAM):
            grams = grams * _ODD + h[0][j : j + len(grams)]
        grams = mixed(grams)
        least = grams[place] if len(place) else np.zeros(0, np.uint64)
        for j in range(1, _RUN):
            np.minimum(least, grams[place + j], out=least)
        fresh = np.ones(len(of), bool)
        fresh[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
        run = np.flatnonzero(fresh)
        size = np.diff(run, append=len(of))
        parts = -(-size // _RUN)  # more than one only where a text repeats itself
        inner = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        run = np.repeat(run, parts) + inner * _RUN
        self.size = np.minimum(np.repeat(size, parts) - inner * _RUN, _RUN)
        self.doc, self.start = of[run], place[run]
        self.key = mixed(least[run] * _ODD)  # spread again, as the least of some hashes is small

    def spans(self, start: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
        """The two hashes of spans of the chunk's words."""
        return [mixed((p[start + words] - p[start]) * i[start] + words.astype(np.uint64)) for p, i in zip(self.prefix, self.powers.inverse, strict=True)]

    def singles(self, crowd: np.ndarray) -> None:
        """Cuts the segments whose keys the filter takes for crowded into their windows; `single` says which they are."""
        self.single = passing(crowd, self.key)
        n = np.where(self.single, self.size, 1)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.start = np.repeat(self.start, n) + inner
        self.size = np.where(np.repeat(self.single, n), 1, np.repeat(self.size, n))
        self.doc, self.key, self.single = (np.repeat(x, n) for x in (self.doc, self.key, self.single))

    def only(self, some: np.ndarray) -> None:
        for name in ("doc", "start", "size", "key"):
            setattr(self, name, getattr(self, name)[some])
        if hasattr(self, "single"):
            self.single = self.single[some]


def scanned(run):
    """A function for mapInArrow over (row, id, text): run(chunk, ids, rows) is called for each chunk of a batch's documents."""

    def wrapped(batches):
        powers = Powers()
        for b in batches:
            ids, rows = b.column("id"), b.column("row").to_numpy()
            held: list[bytes] = []
            n = begun = 0
            for at, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                text = text or b""
                if held and n + len(text) > CHUNK_BYTES:
                    yield run(Chunk(powers, held), ids.slice(begun, at - begun), rows[begun:at])
                    held, n, begun = [], 0, at
                held.append(text)
                n += len(text)
            if held:
                yield run(Chunk(powers, held), ids.slice(begun, len(held)), rows[begun : begun + len(held)])

    return common.freeing(wrapped)


def order_of(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each id, position of an id of each rank); null is first."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    value = ids.fill_null(0).to_numpy(zero_copy_only=False)
    order, starts = groups(known, value)
    rank = np.zeros(len(order), np.int64)
    rank[starts[1:]] = 1
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(rank)
    return out, order[starts]


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows sorted by the keys, and where each group of equal ones begins."""
    order = np.lexsort(keys[::-1])
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(fresh)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, n) of the keys in documents of more than one doc_id; n is at least the number of their different segments."""

    def run(chunk: Chunk, ids: pa.Array, _) -> pa.RecordBatch:
        rank, of = order_of(ids)
        seg = chunk.spans(chunk.start, chunk.size + WINDOW - 1)[0]
        order, first = groups(chunk.key, seg)
        key, n = chunk.key[order], np.zeros(len(order), np.int64)
        n[first] = 1
        by, starts = key, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        ranks = rank[chunk.doc[order]]
        low, high, count = (f.reduceat(x, starts) if len(starts) else np.zeros(0, np.int64) for f, x in ((np.minimum, ranks), (np.maximum, ranks), (np.add, n)))
        more = np.flatnonzero(high > low)
        keys, at, count = np.concatenate((by[starts], by[starts][more])), np.concatenate((low, high[more])), np.concatenate((count, np.zeros(len(more), np.int64)))
        way = np.argsort(at, kind="stable")  # equal ids side by side shuffle in fewer bytes
        return pa.RecordBatch.from_arrays([signed(keys[way]), ids.take(pa.array(of[at[way]])), pa.array(count[way].astype(np.int32))], ["key", "id", "n"])

    found = rows.mapInArrow(scanned(run), "key bigint, id bigint, n int").repartition(common.partitions(rows.sparkSession), "key")
    both = found.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.max(F.col("id").isNull()).alias("none"), F.sum("n").alias("n"))
    return both.where((F.col("a") < F.col("z")) | (F.col("none") & F.col("a").isNotNull())).select("key", "n")


def filter_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of keys(key), two bits a key, made in pieces by the tasks; FILTER_BYTES at most on the driver."""
    n = keys.count()
    bits = min(max(10, math.ceil(math.log2(FILTER_BITS * max(n, 1)))), int(math.log2(8 * FILTER_BYTES)))
    pieces = min(64, 1 << (bits - 10))
    inside = (1 << bits) // pieces
    shift = bits - int(math.log2(pieces))

    def build(table: pa.Table) -> pa.Table:
        marks = np.zeros(inside, bool)
        at = table.column("at").to_numpy()
        marks[at & (inside - 1)] = True
        return pa.table([pa.array([int(at[0]) >> shift]), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], names=["piece", "bits"])

    first = F.shiftrightunsigned("key", 64 - bits)
    second = F.shiftrightunsigned("key", 64 - 2 * bits).bitwiseAND((1 << bits) - 1)
    both = keys.select(F.explode(F.array(first, second)).alias("at")).distinct()
    got = both.groupBy(F.shiftright("at", shift).alias("p")).applyInArrow(build, "piece bigint, bits binary").collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in got:
        out[r["piece"] * inside // 8 : (r["piece"] + 1) * inside // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def passing(marks: np.ndarray, key: np.ndarray) -> np.ndarray:
    bits = int(math.log2(8 * len(marks)))
    first, second = key >> np.uint64(64 - bits), (key >> np.uint64(64 - 2 * bits)) & np.uint64((1 << bits) - 1)
    hit = lambda at: (marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return (hit(first) & hit(second)).astype(bool)


def dealt(rows: DataFrame, filters, shards: int) -> DataFrame:
    """(shard, key, seg, seg2, words, id, n): of each chunk the different segments that pass, with their least id and how often
    they stand there. Windows of crowded keys have no words."""

    def run(chunk: Chunk, ids: pa.Array, _) -> pa.RecordBatch:
        shared, crowd = filters.value
        chunk.only(passing(shared, chunk.key))
        chunk.singles(crowd)
        rank, of = order_of(ids)
        seg, seg2 = chunk.spans(chunk.start, chunk.size + WINDOW - 1)
        order, first = groups(chunk.key, seg, seg2)
        low = np.minimum.reduceat(rank[chunk.doc[order]], first) if len(first) else np.zeros(0, np.int64)
        n, one = np.diff(first, append=len(order)), order[first]
        a, z = chunk.begin[chunk.start[one]], chunk.end[chunk.start[one] + chunk.size[one] + WINDOW - 2]
        words = [None if s else chunk.flat[i:j] for i, j, s in zip(a.tolist(), z.tolist(), chunk.single[one].tolist(), strict=True)]
        shard = (np.where(chunk.single[one], seg[one], chunk.key[one]) % np.uint64(shards)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(shard), signed(chunk.key[one]), signed(seg[one]), signed(seg2[one]), pa.array(words, pa.binary()), ids.take(pa.array(of[low])), pa.array(n)], ["shard", "key", "seg", "seg2", "words", "id", "n"]
        )

    return rows.mapInArrow(scanned(run), "shard bigint, key bigint, seg bigint, seg2 bigint, words binary, id bigint, n bigint")


def places(rows: DataFrame, filters) -> DataFrame:
    """(row, at, size, id, seg, seg2): where segments stand that the third filter has."""

    def run(chunk: Chunk, ids: pa.Array, numbers: np.ndarray) -> pa.RecordBatch:
        shared, crowd, wanted = filters.value
        chunk.only(passing(shared, chunk.key))
        chunk.singles(crowd)
        seg, seg2 = chunk.spans(chunk.start, chunk.size + WINDOW - 1)
        some = passing(wanted, seg)
        chunk.only(some)
        at = (chunk.start - chunk.first[chunk.doc]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(numbers[chunk.doc]), pa.array(at), pa.array(chunk.size.astype(np.int32)), ids.take(pa.array(chunk.doc)), signed(seg[some]), signed(seg2[some])], ["row", "at", "size", "id", "seg", "seg2"])

    return rows.mapInArrow(scanned(run), "row bigint, at int, size int, id bigint, seg bigint, seg2 bigint")


class Bits:
    """A row of bits, packed, with the number of ones before every 64th."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(packed) // 8 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << inside) - np.uint64(1)))


def huffman(counts: np.ndarray) -> np.ndarray:
    """The code length of each symbol."""
    if len(counts) == 1:
        return np.ones(1, np.int64)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, n = [0] * (2 * len(counts) - 1), len(counts)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = n
        heapq.heappush(heap, (a + b, n))
        n += 1
    depth = [0] * n
    for i in range(n - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return np.array(depth[: len(counts)], np.int64)


class WaveletTree:
    """A Huffman-shaped wavelet tree of a row of symbols 0, 1, ...: frequent symbols take few bits, rare ones more."""

    def __init__(self, row: np.ndarray, counts: np.ndarray):
        self.size = huffman(counts)
        order = np.lexsort((np.arange(len(counts)), self.size))  # canonical codes: shorter ones first
        self.code = np.zeros(len(counts), np.int64)
        code, last = 0, 0
        for s in order.tolist():
            code <<= int(self.size[s]) - last
            last = int(self.size[s])
            self.code[s] = code
            code += 1
        self.levels = []
        size, code = self.size[row], self.code[row]
        node = np.zeros(len(row), np.int64)  # ascending on every level
        for level in range(int(self.size.max())):
            bit = (code >> (size - level - 1)) & 1
            bits = Bits(bit)
            starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            on = self.size > level
            names = np.searchsorted(node[starts], self.code >> np.maximum(self.size - level, 0)) * on  # the node of each symbol that gets so deep
            self.levels.append((bits, names, starts, bits.ones(starts)))
            # each node's zeros go before its ones, in their order; then symbols whose code is over leave
            of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(node)))
            ones = np.cumsum(bit) - bit
            before = ones - ones[starts][of]
            zeros = np.add.reduceat(1 - bit, starts)
            to = starts[of] + np.where(bit == 1, zeros[of] + before, np.arange(len(node)) - starts[of] - before)
            way = np.empty(len(node), np.int64)
            way[to] = np.arange(len(node))
            way = way[size[way] > level + 1]
            size, code = size[way], code[way]
            node = code >> (size - level - 1)

    def before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        at, left = at.copy(), np.arange(len(at))
        size, code = self.size[symbol], self.code[symbol]
        for level, (bits, names, starts, ones) in enumerate(self.levels):
            left = left[size[left] > level]
            if not len(left):
                break
            node, now = names[symbol[left]], at[left]
            one = bits.ones(starts[node] + now) - ones[node]
            at[left] = np.where((code[left] >> (size[left] - level - 1)) & 1, one, now - one)
        return at


class Index:
    """The FM-index of a text that ends with 0, a symbol that no pattern has; suffixes are sorted by as many symbols as the longest pattern has or more."""

    def __init__(self, text: np.ndarray, longest: int):
        rank, done = text.astype(np.int64), 1
        while True:
            ahead = np.concatenate((rank[done:], np.full(min(done, len(rank)), -1)))[: len(rank)]
            pair = rank * (int(rank.max()) + 2) + ahead + 1
            self.suffix = np.argsort(pair, kind="stable")
            done *= 2
            if done >= longest:
                break
            ordered = pair[self.suffix]
            rank = np.empty(len(pair), np.int64)
            rank[self.suffix] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1])))
        counts = np.bincount(text)
        self.start = np.concatenate(([0], np.cumsum(counts)))
        self.tree = WaveletTree(text[self.suffix - 1], counts)  # the symbol before each suffix; before the first, the 0 at the end

    def statistics(self, text: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the places where matches end: how many symbols back a match goes that is found in two places or more,
        up to longest, and for those that reach it, from where to where their suffixes stand in the index."""
        reach = np.zeros(len(ends), np.int64)
        lo, hi = self.start[text[ends]], self.start[text[ends] + 1]
        left = np.arange(len(ends))
        for k in range(1, longest + 1):
            if k > 1:
                c = text[ends[left] - k + 1]
                both = self.tree.before(np.concatenate((c, c)), np.concatenate((lo[left], hi[left])))
                lo[left] = self.start[c] + both[: len(left)]
                hi[left] = self.start[c] + both[len(left) :]
            left = left[hi[left] - lo[left] > 1]
            reach[left] = k
            if not len(left):
                break
        return reach, lo, hi


def window_marks(texts: list[list[bytes]], own: np.ndarray) -> np.ndarray:
    """For each of different segments a number whose bit i is set if the window i words in stands at a smaller id too."""
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.zeros(int((sizes + 1).sum()), np.int64)  # 0 ends a segment
    first = np.cumsum(sizes + 1) - sizes - 1
    at = np.arange(len(text)) - np.repeat(first, sizes + 1)
    text[at < np.repeat(sizes, sizes + 1)] = np.fromiter(map(Numbers().__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    index = Index(text, WINDOW)
    n = sizes - WINDOW + 1
    of = np.repeat(np.arange(len(sizes)), n)  # the segment of each window
    window = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    reach, lo, hi = index.statistics(text, first[of] + window + WINDOW - 1, WINDOW)
    full = np.flatnonzero(reach == WINDOW)
    marks = np.zeros(len(sizes), np.int64)
    if len(full):
        by_suffix = np.append(np.repeat(own, sizes + 1)[index.suffix], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(by_suffix, np.column_stack((lo[full], hi[full])).ravel())[::2]
        gone = full[least < own[of[full]]]
        np.bitwise_or.at(marks, of[gone], 1 << window[gone])
    return marks


def searched(shards: DataFrame) -> DataFrame:
    """(seg, seg2, least, marks) of the segments that stand in more than one place or have a window at a smaller id."""

    def one(table: pa.Table) -> pa.Table:
        with common.returned():
            table = table.combine_chunks()
            key, seg, seg2, n = (table.column(c).to_numpy() for c in ("key", "seg", "seg2", "n"))
            ids = table.column("id").combine_chunks()
            rank, at = order_of(ids)
            order, first = groups(key, seg, seg2)
            own, times, rows = np.minimum.reduceat(rank[order], first), np.add.reduceat(n[order], first), order[first]
            same = key[rows]
            alone = np.ones(len(rows), bool)  # a key with one segment: nothing else can match it
            alone[1:] &= same[1:] != same[:-1]
            alone[:-1] &= same[1:] != same[:-1]
            words = table.column("words").take(pa.array(rows))
            index = np.flatnonzero(~alone & words.is_valid().to_numpy())
            marks = np.zeros(len(rows), np.int64)
            if len(index):
                marks[index] = window_marks([w.split() for w in words.take(pa.array(index)).to_pylist()], own[index])  # ASCII white space alone, the same as the pattern's
            some = np.flatnonzero((times > 1) | (marks != 0))
            return pa.table([pa.array(seg[rows[some]]), pa.array(seg2[rows[some]]), ids.take(pa.array(at[own[some]])), pa.array(marks[some])], names=["seg", "seg2", "least", "marks"])

    return shards.groupBy("shard").applyInArrow(one, "seg bigint, seg2 bigint, least bigint, marks bigint")


def removals(rows: DataFrame) -> DataFrame:
    """(row, cuts) for the rows of rows(doc, row) that lose words: a number for each place, its start and the bits of its windows."""
    spark = rows.sparkSession
    rows = rows.select("row", F.col("doc.doc_id").cast("long").alias("id"), F.col("doc.text").alias("text"))
    held = []

    def stored(df: DataFrame, name: str) -> DataFrame:
        held.append(common.stored(df, name))
        return held[-1]

    try:
        keys = stored(shared_keys(rows), "keys")
        size = keys.agg(F.sum(F.least("n", F.lit(CROWDED))).alias("n")).first()["n"] or 0  # a segment has WINDOW words and some more
        shared, crowd = filter_of(keys), filter_of(keys.where(F.col("n") > CROWDED))
        two = spark.sparkContext.broadcast((shared, crowd))
        judged = stored(searched(dealt(rows, two, max(1, math.ceil(size * (WINDOW + 4) / SHARD_WORDS)))), "marks")
        three = spark.sparkContext.broadcast((shared, crowd, filter_of(judged.select(F.col("seg").alias("key")))))
        met = places(rows, three).join(judged.hint("merge"), ["seg", "seg2"])  # a segment in very many places: a skewed join, which Spark splits
        later = F.col("id").isNotNull() & (F.col("least").isNull() | (F.col("id") > F.col("least")))
        bits = F.when(later, F.expr("shiftleft(1L, size) - 1")).otherwise(F.col("marks"))
        cut = F.shiftleft(F.col("at").cast("long"), _RUN).bitwiseOR(bits)
        gone = met.where(bits != 0).groupBy("row").agg(F.collect_list(cut).alias("cuts"))  # one document's own
        return common.stored(gone, "cuts")
    finally:
        for table in held:
            common.dropped(table)


def covered(n: int, cuts: np.ndarray) -> np.ndarray:
    """Which of n words stand in a window that goes."""
    change = np.zeros(n + 1, np.int64)
    for j in range(_RUN):
        start = (cuts[(cuts >> j) & 1 == 1] >> _RUN) + j
        np.add.at(change, start, 1)
        np.add.at(change, start + WINDOW, -1)
    return np.cumsum(change[:n]) > 0


def remaining(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with n_words, n_removed and the kept words joined by one space."""
    rows = common.numbered(docs.select("doc_id", "text"), "substring-rows")
    cuts = removals(rows)
    both = rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")).join(cuts.hint("merge"), "row", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for text, c in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("cuts"), strict=True):
                words = (text or b"").split()
                if c.is_valid:
                    gone = covered(len(words), c.values.to_numpy())
                    out.append((len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])))
                else:
                    out.append((len(words), 0, b" ".join(words)))
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            kept = pa.array(cols[2], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), kept], ["doc_id", "n_words", "n_removed", "kept"])

    return both.select("doc_id", "text", "cuts").mapInArrow(common.freeing(run), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remaining(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = {
    "op11_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, w FROM d),
s AS (SELECT doc_id, i, word, CASE WHEN i + {WINDOW - 1} <= len(w) THEN array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') END AS g FROM p),
m AS (SELECT doc_id, i, word, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS hit FROM s),
c AS (SELECT doc_id, i, word, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
}
QUERIES = {"op11_substring_dedup": op11_substring_dedup}
