"""Operators 11, 12 and 13 against plain Python, on invented rows and through their queries."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from lodestar.llm import centroids, fill_middle, substring_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(rows):
    """(doc_id, words, removed, kept's hash) by the contract's words alone."""
    low = lambda i: -math.inf if i is None else i
    least: dict = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(low(i), least.get(g, math.inf))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < low(i):
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    few = [f"w{i}" for i in range(40)]
    line = [rng.choice(few) for _ in range(30)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, " ".join(line)), (4, " ".join(line)), (None, " ".join(line[5:])), (None, " ".join(line[2:22]))]
    for i in range(5, 60):
        words = [rng.choice(few) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            at, a = rng.randrange(len(words) + 1), rng.randrange(18)
            words[at:at] = line[a : a + rng.randrange(10, 30)]
        rows.append((rng.choice([i, i, i // 2]), rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(70, "x " * 900), (71, "x " * 40 + "y " * 40), (72, "y " * 30), (73, "x y " * 300), (74, "é 😀 " * 20 + " "), (75, "é 😀 " * 14)]
    phrase = [f"p{i}" for i in range(16)]
    rows += [(100 + i, " ".join([f"a{rng.random()}", *phrase[: 16 - i % 4], f"b{rng.random()}"] * 2)) for i in range(30)]
    return rows


@pytest.mark.parametrize(("crowded", "shard"), [(1000, 150_000), (3, 60), (0, 60)])
def test_substrings(spark, monkeypatch, crowded, shard):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    rows = texts(crowded)
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, row int, seg string, id int").repartition(5)
    got = substring_dedup.remaining(df).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got), key=str) == cut_words(rows)
    assert 100 < sum(r["n_removed"] for r in got) < sum(r["n_words"] for r in got)
    assert substring_dedup.remaining(df.where("false")).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FILTER_BYTES", 128)
    rows = texts(8)
    got = substring_dedup.remaining(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in got), key=str) == [r[:3] for r in cut_words(rows)]


def test_index_counts_and_statistics():
    rng = np.random.default_rng(3)
    for symbols, n in ((1, 5), (2, 300), (50, 2000), (1500, 2000)):
        text = rng.zipf(1.3, n) % symbols
        text = np.append(np.unique(text, return_inverse=True)[1] + 1, 0)
        index = substring_dedup.Index(text, 8)
        row = text[index.suffix - 1]
        s, at = text[rng.integers(0, n, 200)], rng.integers(0, n + 2, 200)
        assert index.tree.before(s, at).tolist() == [int((row[:a] == c).sum()) for c, a in zip(s, at, strict=True)]
        ends = np.arange(7, n)
        reach, lo, hi = index.statistics(text, ends, 8)
        seen: dict = {}
        for k in range(1, 9):
            for a in range(n - k + 1):
                seen[tuple(text[a : a + k])] = seen.get(tuple(text[a : a + k]), 0) + 1
        for e, r, a, z in zip(ends, reach, lo, hi, strict=True):
            back = [k for k in range(1, 9) if seen[tuple(text[e - k + 1 : e + 1])] > 1]
            assert r == max(back, default=0)
            if r == 8:
                assert e - 7 in index.suffix[a:z] and z - a == seen[tuple(text[e - 7 : e + 1])]


def test_chunks_hold_every_window_once():
    rng = random.Random(4)
    powers = substring_dedup.Powers()
    for few in (2, 5, 5000):
        texts = [[f"w{rng.randrange(few)}".encode() for _ in range(n)] for n in (0, 12, 13, 14, 40, 0, 500)]
        raw = [rng.choice([b" ", b"\n \t", b"\x0b"]).join(t) for t in texts]
        chunk = substring_dedup.Chunk(powers, raw)
        assert [chunk.flat[a:z] for a, z in zip(chunk.begin, chunk.end, strict=True)] == [w for t in texts for w in t]
        seg = chunk.spans(chunk.start, chunk.size + 12)
        assert len(chunk.size) == 0 or chunk.size.max() <= 9
        windows, same = [], {}
        for d, a, k, key, *h in zip(chunk.doc, chunk.start - chunk.first[chunk.doc], chunk.size, chunk.key, *seg, strict=True):
            windows += [(d, x) for x in range(a, a + k)]
            same.setdefault(tuple(texts[d][a : a + k + 12]), set()).add((key, *h))
            for x in range(a, a + k):
                same.setdefault(tuple(texts[d][x : x + 13]), set()).add(key) if k > 1 else None
        assert windows == [(d, x) for d, t in enumerate(texts) for x in range(len(t) - 12)]
        assert all(len({v if isinstance(v, np.uint64) else v[0] for v in s}) == 1 for s in same.values())
        assert all(len({v for v in s if isinstance(v, tuple)}) <= 1 for s in same.values())


def middle(i, text):
    s = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(s[k : k + 8], 16) for k in (0, 8, 16, 24)]
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, z = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{z}<P>{p}<M>{m}" if h[3] % 100 < 80 else f"<P>{p}<S>{z}<M>{m}"
    return n, "spm" if h[3] % 100 < 80 else "psm", len(p), len(m), out


def test_middles(spark):
    rng = random.Random(9)
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a b c d"), (7, "word " * 30_000), (8, "a<P>b"), (8, "a<P>b"), (9, "😀 é   x   y".encode("utf-16", "surrogatepass").decode("utf-16"))]
    rows += [(i, "".join(rng.choice(["<", "P>", "<S", "M", ">", " ", "\n", "é", "😀", "ab", "\x00", "\x0b", "\x85"]) for _ in range(rng.randrange(40)))) for i in range(20, 300)]
    df = spark.createDataFrame([(*r, 5, "f") for r in rows], "doc_id long, text string, n int, form string")
    made = fill_middle.middles(df)
    assert made.columns == [*df.columns, "fim"]
    forms = set()
    for r in made.collect():
        f = r["fim"]
        want = middle(r["doc_id"], r["text"] or "")
        assert (f["n"], f["form"], f["prefix_chars"], f["middle_chars"], f["output"]) == want
        assert f["output_sha256"] == hashlib.sha256(want[4].encode()).hexdigest() and f["restored_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        forms.add(f["form"])
    assert forms == {"plain", "psm", "spm"} and fill_middle.middles(df.where("false")).count() == 0


def lloyd(rows, k, rounds):
    kept = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), [math.floor(256 * x) for x in v], i) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v))
    x = np.array([v for _, v, _ in kept])
    c = x[:k].copy()
    for last in range(rounds + 1):
        d = np.square(x[:, None] - c[None]).sum(2)
        to = d.argmin(1)
        if last < rounds:
            c = np.array([x[to == j].sum(0) // (to == j).sum() if (to == j).any() else c[j] for j in range(len(c))])
    return sorted(((i, int(j), int(e)) for (_, _, i), j, e in zip(kept, to, d.min(1), strict=True)), key=str), c


def test_centroids(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3, 4, 64) / rng.choice([1, 256])).tolist()) for i in range(150)] + [(None, [0.5] * 64)] * 2 + [(9, [0.5] * 64), (9, [-0.001] * 64)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [None] + [1.0] * 63), (204, [float("nan")] + [1.0] * 63), (205, [float("-inf")] + [1.0] * 63)]
    df = spark.createDataFrame([(*r, 3, 4) for r in rows], "vec_id long, embedding array<double>, cluster int, x int").repartition(3)
    found, c = centroids.clusters(spark, df, k=12, rounds=4)
    want, centres = lloyd(rows, 12, 4)
    assert sorted((r[:] for r in found.collect()), key=str) == want and (c == centres).all()
    few, c = centroids.clusters(spark, df.where("vec_id < 3"), k=12)
    assert len(c) == 3 and {r["distance"] for r in few.collect()} == {0}
    none, c = centroids.clusters(spark, df.where("vec_id >= 200"))
    assert len(c) == 0 and none.count() == 0


def test_screening_measures_less_and_gives_the_same():
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(400, 64)) * np.repeat(rng.choice([1, 40, 900], (400, 8)), 8, axis=1)).astype(np.int64)
    c = x[:20]
    cluster, d, measured = centroids.nearest(x, *centroids.norms(x), c)
    every = np.square(x[:, None] - c[None]).sum(2)
    assert (cluster == every.argmin(1)).all() and (d == every.min(1)).all() and measured < 0.7 * every.size
    assert (centroids.bounds(*centroids.norms(x), *centroids.norms(c)) <= every).all()


def test_queries_by_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = substring_dedup.op11_substring_dedup(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    assert sorted((r[:] for r in got.collect()), key=str) == cut_words(docs)
    got = fill_middle.op12_fill_middle(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r[:] for r in got.collect()) == sorted((i, *(m := middle(i, t))[:4], sha(m[4]), sha(t)) for i, t in docs)
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, c = lloyd(vectors, 40, 5)
    rows = centroids.op13_centroid_clusters(spark, SF).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in rows), key=str) == want
    for r in rows:
        own = [d for _, j, d in want if j == r["cluster"]]
        assert (r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) == (sum(own), sum(d for *_, d in want), sha(",".join(map(str, c[r["cluster"]]))))
