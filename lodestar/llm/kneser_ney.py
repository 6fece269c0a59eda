"""Interpolated modified Kneser-Ney language model, counted in Spark (operator 6).

Order two. Words are hashed by prefix sums over the bytes of a whole batch. Map tasks pre-count words and word
pairs and send them as sorted, delta-coded blocks to shards of the hash space; a reducer merges one shard's blocks
and writes sorted hash arrays to the shared folder. Statistics of contexts and continuations make a second, much
smaller exchange. Workers memory-map the arrays and score whole texts; nothing of the model is held in memory.
Only counts of counts (a few numbers) reach the driver. Pairs are spread by the hash of the pair, so that a word
that is in a third of all pairs does not make a large shard.

    P(w | v)  = max(c(v w) - D(c), 0) / c(v) + g(v) P(w)
    P(w)      = max(n(w) - D'(n), 0) / sum n + l / (V + 1)        n(w): distinct words ahead of w

Words are 64-bit hashes in the vocabulary, so that counts are exact but for collisions of 64 bits; in pairs each
word has 40 bits.

Defined results: null and empty texts are one end token; texts of any length are scored whole; an empty training fold gives every token the probability
1 / (V + 1) = 1; a null doc_id belongs to the training fold; repeated rows count as often as they stand; other
columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT = 5, 1
U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
BEGIN, END = U(0x0123456789ABCDEF), U(0xFEDCBA9876543210)
PAIR_BITS = 40
FLUSH = 3_000_000  # tokens that a map task counts before it sends
BLOCK_BYTES = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hasher:
    """Token hashes of the texts of a batch, an end token after each text."""

    def __init__(self):
        self.power = np.array([1], U)
        self.inverse = np.array([1], U)

    def _grow(self, n: int) -> None:
        while len(self.power) <= n:
            k = len(self.power)
            self.power = np.concatenate([self.power, self.power * U(pow(BASE, k, 1 << 64))])
            self.inverse = np.concatenate([self.inverse, self.inverse * U(pow(BASE, -k, 1 << 64))])

    def tokens(self, texts: pa.Array):
        """Yields (first text, tokens, tokens per text) for runs of texts of about BLOCK_BYTES."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
            yield at, *self._block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to

    def _block(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(raw)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        first = np.ones(n + 1, bool)  # a byte before which a word can begin
        first[1:n] = space[:-1]
        first[offsets] = True
        starts = np.flatnonzero(first[:n] & ~space)
        ends = np.flatnonzero((np.append(space[1:], True) | first[1:]) & ~space) + 1 if n else starts
        self._grow(n)
        low = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
        sums = np.concatenate((np.zeros(1, U), np.cumsum((low.astype(U) + U(1)) * self.power[:n])))
        words = mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(U))
        of = np.searchsorted(offsets, starts, "right") - 1 if len(starts) else starts
        # empty texts share an offset with the text after them; the last text that begins there has the words
        counts = np.bincount(of, minlength=len(offsets) - 1)[: len(offsets) - 1] + 1
        out = np.full(len(words) + len(counts), END, U)
        out[np.arange(len(words)) + of] = words
        return out, counts


def contexts(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token ahead of each token; BEGIN for a text's first."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(counts) - counts] = BEGIN
    return out


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Identity of a pair from the top PAIR_BITS of its words."""
    s = U(64 - PAIR_BITS)
    return mixed((v >> s) * U(0xD6E8FEB86659FD93) + (w >> s))


# Blocks: arrays of 64-bit numbers, the first ascending, as byte planes of differences.


def packed(*columns: np.ndarray) -> bytes:
    parts = [np.array([len(columns[0])], U).tobytes()]
    for i, c in enumerate(columns):
        c = np.diff(c, prepend=U(0)) if i == 0 else c
        parts.append(np.ascontiguousarray(c.astype(U).view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(block: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    n, out = int(raw[:8].view(U)[0]), []
    for i in range(columns):
        c = np.ascontiguousarray(raw[8 + i * 8 * n : 8 + (i + 1) * 8 * n].reshape(8, n).T).view(U).ravel()
        out.append(np.cumsum(c, dtype=U) if i == 0 else c)
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with sums of the values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys)
    keys = keys[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[cuts], *(np.add.reduceat(v[order], cuts) for v in values)


def _shards(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(shards) >> U(32)).astype(np.int64)


WORDS, PAIRS, CONTEXTS, CONTINUED, TALLY = range(5)
ROW = "kind int, shard int, block binary"


def _rows(out: list) -> pa.RecordBatch:
    k, s, b = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(s, pa.int32()), pa.array(b, pa.binary())], ["kind", "shard", "block"])


def _dealt(kind: int, shards: int, by: np.ndarray, *columns: np.ndarray) -> list:
    """A block per shard; columns are sorted by (shard, first column) here."""
    s = _shards(by, shards)
    order = np.lexsort((columns[0], s))
    s, columns = s[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(s, prepend=-1))
    return [(kind, int(s[a]), packed(*(c[a:z] for c in columns))) for a, z in zip(cuts, [*cuts[1:], len(s)], strict=True)]


def counted(train: DataFrame, shards: tuple[int, int]) -> DataFrame:
    """Blocks of pre-counted words and pairs of train(text)."""

    def run(batches):
        hasher, held, n = Hasher(), [], 0

        def flush():
            tok, ctx = (np.concatenate(x) for x in zip(*held, strict=True))
            words, c = summed(tok, np.ones(len(tok), U))
            begun = int((ctx == BEGIN).sum())
            out = _dealt(WORDS, shards[0], np.append(words, BEGIN), np.append(words, BEGIN), np.append(c, U(begun)))
            g = pair(ctx, tok)
            order = np.argsort(g)
            g = g[order]
            cuts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            s = U(64 - PAIR_BITS)
            out += _dealt(PAIRS, shards[1], g[cuts], ctx[order[cuts]] >> s, tok[order[cuts]] >> s, np.diff(cuts, append=len(g)).astype(U))
            held.clear()
            return _rows(out)

        for b in batches:
            for _, tok, counts in hasher.tokens(b.column("text")):
                held.append((tok, contexts(tok, counts)))
                n += len(tok)
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return train.select("text").mapInArrow(common.freeing(run), ROW)


def _write(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Under another name first: a repeated task leaves the same whole file."""
    own = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(own, "wb") as f:
        f.write(np.array([len(arrays[0])], U).tobytes())
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    os.replace(own, os.path.join(folder, name))


def merged(blocks: DataFrame, folder: str, words_shards: int) -> DataFrame:
    """Merges each shard; pairs go to files, what contexts and continuations need is sent on."""

    def run(table: pa.Table) -> pa.Table:
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        parts = [unpacked(b.as_py(), 2 if kind == WORDS else 3) for b in table.column("block")]
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        del parts
        if kind == WORDS:
            words, c = summed(*cols)
            real = words != BEGIN
            out = [(WORDS, shard, packed(words, c)), (TALLY, -1, np.array([real.sum(), c[real].sum(), 0, 0, 0, 0], U).tobytes())]
        else:
            v, w, c = cols
            s = U(64 - PAIR_BITS)
            g = pair(v << s, w << s)
            order = np.argsort(g)
            g, v, w = g[order], v[order], w[order]
            cuts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            c = np.add.reduceat(c[order], cuts)
            g, v, w = g[cuts], v[cuts], w[cuts]
            many = c >= U(255)
            _write(folder, f"pairs-{shard}", g, np.append(g[many], U(int(many.sum()))), c[many], np.minimum(c, U(255)).astype(np.uint8))
            out = [(TALLY, shard, np.array([0, 0, *((c == U(k)).sum() for k in (1, 2, 3, 4))], U).tobytes())]
            seen = summed(v, (c == U(1)).astype(U), (c == U(2)).astype(U), (c > U(2)).astype(U))
            out += _dealt(CONTEXTS, words_shards, seen[0] << s, *seen)
            cont = summed(w, np.ones(len(w), U))
            out += _dealt(CONTINUED, words_shards, cont[0] << s, *cont)
        return pa.Table.from_batches([_rows(out)])

    return blocks.groupBy("kind", "shard").applyInArrow(run, ROW)


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, 3 and more, from the counts of counts."""
    if not n[0]:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return [d if 0 < d <= k else k / 2 for k, d in zip((1, 2, 3), out, strict=True)]


def vocabulary(parts: DataFrame, folder: str, d: list[float]) -> DataFrame:
    """Writes each shard's words with count, weight of the lower order, and continuations; tallies the last."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        by: dict[int, list] = {WORDS: [], CONTEXTS: [], CONTINUED: []}
        for kind, b in zip(table.column("kind").to_pylist(), table.column("block"), strict=True):
            by[kind].append(unpacked(b.as_py(), 4 if kind == CONTEXTS else 2))
        if not by[WORDS]:
            return pa.Table.from_batches([_rows([])])
        words, c = (np.concatenate(x) for x in zip(*by[WORDS], strict=True))
        top = words >> U(64 - PAIR_BITS)

        def found(kind: int, columns: int) -> list[np.ndarray]:
            if not by[kind]:
                return [np.zeros(len(words), U)] * columns
            keys, *values = summed(*(np.concatenate(x) for x in zip(*by[kind], strict=True)))
            at = np.minimum(np.searchsorted(keys, top), len(keys) - 1)
            return [np.where(keys[at] == top, x[at], U(0)) for x in values]

        n1, n2, n3 = found(CONTEXTS, 3)
        (cont,) = found(CONTINUED, 1)
        gamma = (d[0] * n1 + d[1] * n2 + d[2] * n3) / c
        _write(folder, f"words-{shard}", words, c, gamma.astype(np.float64), cont)
        real = words != BEGIN
        tally = [(cont[real] == U(k)).sum() for k in (1, 2, 3, 4)] + [(cont[real] > U(2)).sum(), cont[real].sum()]
        return pa.Table.from_batches([_rows([(TALLY, shard, np.array(tally, U).tobytes())])])

    return parts.groupBy("shard").applyInArrow(run, ROW)


class Model:
    """The memory-mapped arrays, opened shard by shard."""

    def __init__(self, folder: str, shards: tuple[int, int], d: list[float], d1: list[float], total: int, size: int, tokens: int, lam: float):
        self.folder, self.shards, self.d, self.d1 = folder, shards, np.array([0, *d]), np.array([0, *d1])
        self.total, self.size, self.tokens, self.lam = total, size, tokens, lam
        self.open: dict[str, list | None] = {}
        self.written: frozenset[str] = frozenset()

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def arrays(self, name: str):
        if name not in self.open:
            if name not in self.written:  # no token of this shard was counted
                self.open[name] = None
                return None
            raw = np.memmap(os.path.join(self.folder, name), np.uint8, "r")  # an error where this worker cannot see the folder
            n = int(raw[:8].view(U)[0])
            keys = raw[8 : 8 + 8 * n].view(U)
            if name.startswith("words"):
                cols = [raw[8 + 8 * n * i : 8 + 8 * n * (i + 1)] for i in (1, 2, 3)]
                self.open[name] = [keys, cols[0].view(U), cols[1].view(np.float64), cols[2].view(U)]
            else:
                low = raw[len(raw) - n :]
                rest = raw[8 + 8 * n : len(raw) - n].view(U)
                many = (len(rest) - 1) // 2
                self.open[name] = [keys, low, rest[:many], rest[many + 1 :]]
        return self.open[name]

    def looked_up(self, kind: str, keys: np.ndarray):
        """Yields (slice of the ascending keys, arrays, positions, found) by shard."""
        s = _shards(keys, self.shards[kind == "pairs"])
        cuts = np.flatnonzero(np.diff(s, prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(s)], strict=True):
            got = self.arrays(f"{kind}-{s[a]}")
            if got is None or not len(got[0]):
                continue
            at = np.minimum(np.searchsorted(got[0], keys[a:z]), len(got[0]) - 1)
            yield slice(a, z), got, at, got[0][at] == keys[a:z]

    def words(self, keys: np.ndarray):
        c, gamma, cont = np.zeros(len(keys)), np.ones(len(keys)), np.zeros(len(keys))
        for part, (_, a, b, n), at, hit in self.looked_up("words", keys):
            c[part], gamma[part], cont[part] = np.where(hit, a[at], 0), np.where(hit, b[at], 1.0), np.where(hit, n[at], 0)
        return c, gamma, cont

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        c = np.zeros(len(keys))
        for part, (_, low, many, count), at, hit in self.looked_up("pairs", keys):
            got = np.where(hit, low[at], 0).astype(float)
            for i in np.flatnonzero(got == 255):
                got[i] = count[np.searchsorted(many, keys[part][i])]
            c[part] = got
        return c

    def scores(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, unigram score, model score) of each text, logarithms to base ten."""
        ctx = contexts(tokens, counts)
        unique, inv = np.unique(tokens, return_inverse=True)
        c, gamma, cont = self.words(unique)
        lower = np.maximum(cont - self.d1[np.minimum(cont, 3).astype(int)], 0) / max(self.total, 1) + self.lam / (self.size + 1)
        base = np.log10((c + 0.5) / (self.tokens + 0.5 * (self.size + 1)))
        c_b, gamma_b, _ = self.words(np.array([BEGIN]))
        first = np.cumsum(counts) - counts
        before = np.empty(len(tokens), np.int64)
        before[1:] = inv[:-1]
        before[first] = len(unique)
        cv, gv = np.append(c, c_b)[before], np.append(gamma, gamma_b)[before]
        grams, at = np.unique(pair(ctx, tokens), return_inverse=True)
        cvw = self.pairs(grams)[at]
        higher = np.maximum(cvw - self.d[np.minimum(cvw, 3).astype(int)], 0)
        p = np.where(cv > 0, higher / np.maximum(cv, 1) + gv * lower[inv], lower[inv])
        return np.add.reduceat((c > 0)[inv].astype(np.int64), first), np.add.reduceat(base[inv], first), np.add.reduceat(np.log10(p), first)


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def trained(train: DataFrame) -> Model:
    """Counts train(text) and leaves the model in the shared folder, which workers must see as a file system."""
    spark = train.sparkSession
    place = urlparse(common.shared_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError("the model is memory-mapped: spark.checkpoint.dir must be a mounted folder (file:) here")
    folder = os.path.join(place.path, f"kneser-ney-{uuid.uuid4().hex}")
    os.makedirs(folder)
    n = common.partitions(spark)
    shards = (max(8, n // 4), 2 * n)  # of words, of pairs: every pair shard sends a block to every word shard
    parts = common.stored(merged(counted(train, shards), folder, shards[0]), "language-model")
    tally, pairs = _tally(parts, 6)
    d = discounts(tally[2:])
    n, words = _tally(vocabulary(parts.where(F.col("kind") != TALLY), folder, d), 6)
    d1 = discounts(n[:4])
    lam = (d1[0] * n[0] + d1[1] * n[1] + d1[2] * n[4]) / n[5] if n[5] else 1.0
    model = Model(folder, shards, d, d1, n[5], tally[0], tally[1], lam)
    model.written = frozenset([*(f"pairs-{s}" for s in pairs), *(f"words-{s}" for s in words)])
    return model


def _tally(rows: DataFrame, width: int) -> tuple[list[int], set[int]]:
    """Sums of the tallies, and the shards that have written a file."""
    out, wrote = [0] * width, set()
    for r in rows.where(F.col("kind") == TALLY).select("shard", "block").collect():  # a few numbers per shard
        out = [a + int(b) for a, b in zip(out, np.frombuffer(r["block"], U), strict=True)]
        wrote.add(r["shard"])
    return out, wrote - {-1}


def scored(docs: DataFrame, model: Model) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hasher = Hasher()
        for b in batches:
            cols = [[], [], [], []]
            for _, tok, counts in hasher.tokens(b.column("text")):
                for col, v in zip(cols, (counts, *model.scores(tok, counts)), strict=True):
                    col.append(v)
            n, known, base, score = (np.concatenate(c) if c else np.zeros(0) for c in cols)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base.astype(float)), pa.array(score.astype(float))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(common.freeing(run), f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    model = trained(docs.where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


ORACLE: dict[str, str] = {}
QUERIES = {"op6_language_model": op6_language_model}
