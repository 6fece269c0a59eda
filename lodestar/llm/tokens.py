"""Token counts of whole texts with overlap resynchronisation (operator 8), and the encoder that operator 7 shares.

A place between two characters is a stable cut where the vocabulary's pre-tokenizer always splits, whatever stands
further away: between a word and the white space after it, between letters and digits or punctuation. The rules look
at the three bytes around the place (and keep special strings whole), so a cut is proven by its neighbourhood alone.
The tokens of a text are those of its units, the parts between stable cuts, and equal units of a run of texts are
encoded once.

A text of over CHUNK bytes is encoded in overlapping chunks with offsets. Neighbours are spliced at the first stable
cut that both encodings have inside the overlap, MARGIN bytes or more from the ends of the chunks, where what lies
outside cannot matter. Where there is none, the overlap is doubled, up to the whole text.

Units of plain letters, digits or punctuation are merged by numpy for all units at once (byte-pair merges in the order
of the vocabulary's ranks); any other unit is given to the library.

Defined results: null and empty texts have no tokens; texts of any length are counted whole in memory bounded by
RUN and the text's own size; repeated rows get a row each; a null doc_id is kept; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

COUNTED = "byte_bpe_50k.json"
CHUNK = 8_192  # bytes from which a text is encoded in overlapping chunks
OVERLAP = 256
MARGIN = 32  # bytes; the rules of a cut look at no more
RUN = 4 << 20  # bytes of texts that are encoded together
AT_ONCE = 65_536  # units that are merged together, which bounds memory
LONGEST = 40  # bytes of a unit that is merged here

#: Classes of bytes. Whatever may be or touch other white space, or may combine, is OTHER: nothing is cut beside it.
OTHER, SPACE, LETTER, DIGIT, QUOTE, PUNCTUATION, FOREIGN, SPECIAL = range(8)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[33:127] = PUNCTUATION
    out[48:58] = DIGIT
    out[65:91] = out[97:123] = LETTER
    out[39] = QUOTE  # contractions begin with it
    out[[10, 32]] = SPACE
    return out


CLASS = _classes()
NEVER = 0x7FFFFFFF


class Merges:
    """Byte-pair merges of a vocabulary, for many short units at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves; the rest follow 255
        char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[char[b] + end] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = max(4, int(4 * len(keys) - 1).bit_length())
        self.key, self.rank = np.full(1 << self.bits, NEVER, np.int64), np.full(1 << self.bits, NEVER, np.int32)
        for k, s, r in zip(keys.tolist(), self._slot(keys).tolist(), range(len(keys)), strict=True):
            while self.key[s] != NEVER:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.key[s], self.rank[s] = k, r
        every = np.arange(256)
        self.first_inner = self.ranks(self.inner[every[:, None]], self.inner[every[None]])
        self.first_last = self.ranks(self.inner[every[:, None]], self.last[every[None]])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER where the vocabulary does not merge it."""
        shape = a.shape if a.ndim >= b.ndim else b.shape
        key = (a.astype(np.int64) << 16 | b).ravel()
        slot = self._slot(key)
        out = np.full(len(key), NEVER, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            have, want = self.key[slot[open_]], key[open_]
            hit = have == want
            out[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (have != NEVER)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out.reshape(np.broadcast_shapes(a.shape, b.shape) or shape)

    def encoded(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, how many each has) for units of 1 to LONGEST bytes.

        Units of one length are rows of a matrix. A round merges the lowest-ranked, leftmost pair of each row; rows
        that merged go on with those that have one symbol less.
        """
        n = len(start)
        ids, count = np.zeros((n, int(size.max(initial=1))), np.uint16), np.zeros(n, np.int64)
        by = np.argsort(size, kind="stable")
        cuts = np.searchsorted(size[by], np.arange(ids.shape[1] + 2))
        row, sym, rank = np.zeros(0, np.int64), np.zeros((0, ids.shape[1] + 1), np.int32), np.zeros((0, ids.shape[1]), np.int32)
        for k in range(ids.shape[1], 0, -1):
            new = by[cuts[k] : cuts[k + 1]]
            raw = data[start[new][:, None] + np.arange(k)]
            fresh = self.inner[raw]
            fresh[:, -1] = self.last[raw[:, -1]]
            own = self.first_inner[raw[:, :-1], raw[:, 1:]]
            if k > 1:
                own[:, -1] = self.first_last[raw[:, -2], raw[:, -1]]
            row, sym, rank = np.concatenate((row, new)), np.concatenate((sym[:, :k], fresh)), np.concatenate((rank[:, : k - 1], own))
            if k == 1:
                ids[row, 0], count[row] = sym[:, 0], 1
                break
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            done = best == NEVER
            ids[row[done], :k], count[row[done]] = sym[done], k
            live = ~done
            row, sym, rank, at, best = row[live], sym[live], rank[live], at[live], best[live]
            every = np.arange(len(row))
            sym[every, at] = self.made[best]
            stay = np.ones(sym.shape, bool)
            stay[every, at + 1] = False
            sym = sym[stay].reshape(len(row), k - 1)
            stay = np.ones(rank.shape, bool)
            stay[every, at] = False
            rank = rank[stay].reshape(len(row), k - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < k - 2)
            rank[left, at[left] - 1] = self.ranks(sym[left, at[left] - 1], sym[left, at[left]])
            rank[right, at[right]] = self.ranks(sym[right, at[right]], sym[right, at[right] + 1])
        return ids[np.arange(ids.shape[1]) < count[:, None]].astype(np.uint32), count


class Encoder:
    """Encodes blocks of texts with one vocabulary; `words` for one that lowers its text and drops white space."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        path = public_tokenizers.path(name)
        self.tok, self.merges = Tokenizer.from_file(path), Merges(path)
        with open(path, encoding="utf-8") as f:
            self.words = bool(json.load(f)["model"]["end_of_word_suffix"])
        self.specials = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        cut = np.zeros((8, 8), bool)
        for a, b in ((LETTER, DIGIT), (LETTER, PUNCTUATION), (DIGIT, PUNCTUATION)):
            cut[a, b] = cut[b, a] = True
        cut[[LETTER, DIGIT], QUOTE] = True
        if self.words:  # digits stand alone; white space goes with what is ahead of it
            cut[DIGIT, DIGIT] = cut[SPACE, 1:] = True
        else:  # white space goes with what follows
            cut[2:, SPACE] = True
        self.cut = cut
        self.fold = np.arange(256, dtype=np.uint8)
        if self.words:
            self.fold[65:91] += 32
            self.fold[10] = 32

    def classes(self, raw: np.ndarray) -> np.ndarray:
        out = CLASS[raw]
        high = np.flatnonzero(raw >= 0xC3)
        if len(high):
            lead = raw[high]
            for low, top, more in ((0xC3, 0xE0, 1), (0xE4, 0xF0, 2), (0xF0, 0xF5, 3)):  # characters that are no white space
                own = high[(lead >= low) & (lead < top)]
                for i in range(more + 1):
                    out[own[own + i < len(raw)] + i] = FOREIGN
            latin = high[(lead == 0xC3) & (high + 1 < len(raw))]
            latin = latin[(raw[latin + 1] != 0x97) & (raw[latin + 1] != 0xB7)]
            out[latin] = out[latin + 1] = LETTER
        return out

    def bounds(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ascending starts of the units of texts that begin at offsets, and the end."""
        kind = self.classes(raw)
        edges = []
        whole = raw.tobytes()
        for s in self.specials:
            at = whole.find(s) if b"<|" in whole else -1
            while at >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(s) - 1, "right"):  # in one text
                    kind[at : at + len(s)] = SPECIAL
                    edges += [at, at + len(s)]
                at = whole.find(s, at + len(s))
        mark = np.zeros(len(raw) + 1, bool)
        mark[1:-1] = self.cut[kind[:-1], kind[1:]]
        if not self.words and len(raw) > 1:
            solid = (kind >= LETTER) & (kind <= FOREIGN)
            solid[offsets[:-1][offsets[:-1] < len(raw)]] = False  # nothing follows the end of a text
            space = kind == SPACE
            mark[1:-2] |= space[:-2] & space[1:-1] & solid[2:]  # the last of a run of white space goes with what follows
            mark[1:-1] |= (raw[:-1] == 10) & solid[1:]  # but a line feed stands alone
        if edges:
            inside = np.flatnonzero(kind == SPECIAL)
            mark[inside] = False
            mark[edges] = True
        mark[offsets] = True
        return np.flatnonzero(mark)

    def _library(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, count, ids): where in ids the tokens of each unit data[at[i]:at[i+1]] lie."""
        start, size = at[:-1].astype(np.int64), np.diff(at).astype(np.int64)
        n = len(size)
        kind = self.classes(data)
        solid = kind.copy()
        solid[kind == SPACE] = 0
        most = np.maximum.reduceat(solid, start) if n else solid
        solid[kind == SPACE] = 255
        least = np.minimum.reduceat(solid, start) if n else solid
        own = np.where((most == least) & np.isin(most, (LETTER, DIGIT, PUNCTUATION)), size, 0)
        if self.words:
            blank = (least == 255) & (size > 0)
            tail = (own > 0) & (data[np.maximum(at[1:] - 1, 0)] == 32)
            own = own - tail
        else:
            blank = np.zeros(n, bool)
            spaces = np.concatenate(([0], np.cumsum(kind == SPACE)))
            inside = spaces[at[1:]] - spaces[at[:-1]]
            own[(inside > 1) | (inside == 1) & (data[start] != 32)] = 0
        short = np.flatnonzero((own > 0) & (own <= LONGEST))
        rest = np.flatnonzero(((own <= 0) | (own > LONGEST)) & ~blank & (size > 0))
        some = [self.merges.encoded(data, start[p], own[p]) for p in np.array_split(short, len(short) // AT_ONCE + 1)]
        ids, count = (np.concatenate(x) for x in zip(*some, strict=True))
        whole = np.ascontiguousarray(data)
        lists = self._library([whole[a : a + k].tobytes().decode() for a, k in zip(start[rest].tolist(), size[rest].tolist(), strict=True)])
        counts, first = np.zeros(n, np.int64), np.zeros(n, np.int64)
        counts[short], counts[rest] = count, [len(x) for x in lists]
        first[short], first[rest] = np.cumsum(count) - count, len(ids) + np.cumsum(counts[rest]) - counts[rest]
        return first, counts, np.concatenate([ids, *(np.array(x, np.uint32) for x in lists)])

    def block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bounds, first, count, ids) of the units of a block of texts; equal units share their ids."""
        at = self.bounds(raw, offsets)
        data = self.fold[raw] if self.words else raw
        if self.words:  # capital Latin-1 letters
            latin = np.flatnonzero(raw[:-1] == 0xC3)
            latin = latin[(raw[latin + 1] >= 0x80) & (raw[latin + 1] <= 0x9E) & (raw[latin + 1] != 0x97)]
            data[latin + 1] += 0x20
        each = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        code, known = each.indices.to_numpy(), each.dictionary
        if not len(known):
            none = np.zeros(0, np.int64)
            return at, none, none, np.zeros(0, np.uint32)
        place = np.frombuffer(known.buffers()[1], np.int32)[known.offset : known.offset + len(known) + 1].astype(np.int64)
        first, count, ids = self.units(np.frombuffer(known.buffers()[2], np.uint8)[place[0] : place[-1]], place - place[0])
        return at, first[code], count[code], ids

    def encoded(self, raw: np.ndarray, offsets: np.ndarray, size: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has); texts over `size` bytes in overlapping chunks."""
        text, lo, hi = [], [], []
        for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            while z - a > size:
                text.append(i)
                lo.append(a)
                hi.append(_whole(raw, a + size))
                a = _whole(raw, a + size - overlap)
            text.append(i)
            lo.append(a)
            hi.append(z)
        lengths = np.array(hi, np.int64) - np.array(lo, np.int64)
        begin = np.concatenate(([0], np.cumsum(lengths)))
        parts = raw if len(text) == len(offsets) - 1 else np.concatenate([raw[a:z] for a, z in zip(lo, hi, strict=True)])
        at, first, count, ids = self.block(parts, begin)
        unit = np.searchsorted(at, begin)  # the first unit of each chunk
        failed = set()
        for c in range(len(text) - 1):
            if text[c] != text[c + 1] or text[c] in failed:
                continue
            mine = at[unit[c] : unit[c + 1]] - begin[c] + lo[c]
            next_ = at[unit[c + 1] : unit[c + 2]] - begin[c + 1] + lo[c + 1]
            left = mine[np.searchsorted(mine, lo[c + 1] + MARGIN) : np.searchsorted(mine, hi[c] - MARGIN)]
            both = left[np.isin(left, next_[: np.searchsorted(next_, hi[c])], assume_unique=True)]
            if not len(both):
                failed.add(text[c])
                continue
            count[unit[c] + np.searchsorted(mine, both[0]) : unit[c + 1]] = 0
            count[unit[c + 1] : unit[c + 1] + np.searchsorted(next_, both[0])] = 0
        ends = np.concatenate(([0], np.cumsum(count)))
        chunk = ends[unit]
        got = ids[np.repeat(first - ends[:-1], count) + np.arange(ends[-1])]
        per = np.bincount(np.array(text, np.int64), np.diff(chunk), len(offsets) - 1).astype(np.int64)
        if not failed:
            return got, per
        own = np.split(got, np.cumsum(per)[:-1])
        for i in failed:  # no common stable cut: wider overlaps, in longer chunks once they are half of one
            a, z = offsets[i], offsets[i + 1]
            wide = 2 * overlap
            own[i], _ = self.encoded(raw[a:z], np.array([0, z - a]), size if 2 * wide < size else 2 * size, wide)
            per[i] = len(own[i])
        return np.concatenate(own), per


def _whole(raw: np.ndarray, at: int) -> int:
    """The start of the character that holds this byte."""
    while raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


@lru_cache
def encoder(name: str) -> Encoder:
    return Encoder(name)


def runs(texts: pa.Array, size: int = RUN):
    """(first text, bytes, offsets) of consecutive texts of about `size` bytes together; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def counts(docs: DataFrame, name: str = COUNTED, limit: int = 512) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        with common.returned():
            code = encoder(name)
            for b in batches:
                size, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for _, raw, offsets in runs(b.column("text")):
                    size.append(np.diff(offsets))
                    n.append(code.encoded(raw, offsets)[1])
                n = np.concatenate(n)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(size)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(common.table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE: dict[str, str] = {}
QUERIES = {"op8_token_counts": op8_token_counts}
