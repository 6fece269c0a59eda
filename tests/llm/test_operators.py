"""The corpus operators on invented rows: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import common, exact_dedup, kneser_ney, mixing, packing, page_text, pii, simhash_dedup, span_hash, tokens, toxicity

LONG = "word " * 30_000
ROWS = [(1, None, "s"), (2, "", "s"), (3, "A b c d e", None), (4, "a B c d e", "s"), (5, "x", "t"), (5, "x", "t"), (7, LONG, "t"), (8, "é 😀 ünï", "u")]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns with names that the operators use inside
    return spark.createDataFrame([(*r, 0, 1, "k") for r in ROWS], "doc_id long, text string, source string, size int, block int, key string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_exact_dedup(spark, docs, none):
    rows = exact_dedup.groups(spark, docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == len(ROWS) and by[1][0]["keep_id"] == 2 and by[3][0]["keep_id"] == 4 and not by[3][0]["kept"]
    assert sorted(r["kept"] for r in by[5]) == [False, True]
    assert by[4][0]["text_sha256"] == hashlib.sha256(b"a b c d e").hexdigest()
    kept = sorted(r["doc_id"] for r in exact_dedup.keep(spark, docs).collect())
    assert kept == [2, 4, 5, 7, 8]
    assert exact_dedup.groups(spark, none).count() == 0


def test_stages_decide_by_row(spark):
    rows = [(5, "alpha one two three four five"), (5, "beta six seven eight nine ten"), (9, "Beta six seven eight nine ten"), (None, "beta six seven eight nine ten"), (None, "gamma")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same = lambda got: sorted(got.collect(), key=str)
    assert same(exact_dedup.keep(spark, df)) == sorted([rows[0], rows[2], rows[4]], key=str)
    assert same(simhash_dedup.keep(spark, df)) == sorted([rows[0], rows[1], rows[4]], key=str)
    clash = ["_row", "row", "_a", "_z", "_n", "_k", "_c", "_h", "a", "z", "n", "fp", "s", "sha", "node", "root", "key", "src", "size", "of", "at", "rank", "epoch", "uid", "part", "hit", "file", "no", "doc", "k", "score", "n_chars", "x.y"]
    names = ", ".join(f"`{c}` int" for c in clash)
    wide = spark.createDataFrame([(*r, "s", *range(len(clash))) for r in rows], f"doc_id long, text string, source string, {names}")
    for stage in (exact_dedup.keep, simhash_dedup.keep, mixing.keep):
        assert stage(spark, wide).columns == wide.columns and stage(spark, wide).count() > 0
    plain = [(i, f"w{i % 7} w{i % 11} w{i % 13}" + " vile rotten" * (i % 5 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 600, 2)], "doc_id long, toxic int")
    extra = [(1, "w1 vile rotten"), (None, "w2 vile rotten"), (None, "w3")]
    left = toxicity.keep(spark, spark.createDataFrame(plain + extra, "doc_id long, text string"), labels)
    assert same(left) == sorted([p for p in plain if p[0] % 5] + extra[2:], key=str)


def test_near_copies_at_their_similarity(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):  # up to four words replaced: similarities on both sides of 0.8
        for j in range(1, 5):
            words = t.split()
            for at in rng.sample(range(5, 95), j):
                words[at] = f"v{rng.randrange(10**6)}"
            rows.append((100 * j + i, " ".join(words)))
    base = [f"c{k}" for k in range(60)]
    rows += [(1000 + i, " ".join([*base[:40], *(f"x{i}y{k}" for k in range(6))])) for i in range(40)]  # one large key
    got = {r["doc_id"] for r in simhash_dedup.keep(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    grams = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    label = list(range(len(rows)))
    near = [(a, b) for a in range(len(rows)) for b in range(a) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    for _ in rows:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(i, least.get(c, i))
    assert got == set(least.values()) and 60 < len(got) < len(rows)


def test_rice_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 500):
        v = np.sort(rng.integers(0, 1 << 50, n).astype(np.uint64))
        k = exact_dedup.rice_parameter(1 << 50, n)
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(v, k), n, k) == v).all()


def test_simhash_components(spark, docs, none):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for f in base for _ in range(12)})
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in common.components(simhash_dedup.links(nodes)).collect()}
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= 4
    label = np.arange(len(a))
    while ((new := np.array([label[r].min() for r in near])) != label).any():
        label = new
    signed = a.view(np.int64)
    cut = {r["node"]: r["root"] for r in common.components(simhash_dedup.links(nodes, 3)).collect()}  # keys of over three are cut
    for g in set(label.tolist()):
        members = signed[label == g].tolist()
        assert {got.get(x, x) for x in members} == {min(members)} == {cut.get(x, x) for x in members}
    rows = {r["doc_id"]: r for r in simhash_dedup.classes(docs).collect()}
    assert rows[1]["fp"] == 0 and rows[2]["component_id"] == 1 and rows[4]["component_id"] == 3
    assert simhash_dedup.classes(none).count() == 0


def test_dense_keys_give_few_links():
    fp = np.unique((np.uint64(5) << np.uint64(43)) | np.arange(400, dtype=np.uint64))
    got = simhash_dedup.key_links(np.zeros(len(fp), np.int32), np.zeros(len(fp), bool), fp)
    assert len(got) < len(fp)


def test_mixing(spark, docs, none):
    rows, pieces = mixing.mixture(spark, docs, block=64)
    size = {r["row"]: r for r in rows.collect()}
    taken = {}
    for p in pieces.collect():
        taken[p["row"]] = taken.get(p["row"], 0) + p["words"]
    assert all(n <= 2 * size[r]["size"] for r, n in taken.items())
    per = {}
    for r in size.values():
        per.setdefault(r["source"], [0, r["target"]])[0] += taken.get(r["row"], 0)
    assert all(abs(a - b) <= 128 for a, b in per.values())
    assert mixing.targets({"a": 10, "b": 10}) == {"a": 20.0, "b": 10.0}
    rows, pieces = mixing.mixture(spark, none)
    assert rows.count() == 0 and pieces.count() == 0


PARTS = [" ", "\n", "\t", "a", "Bc", "é", "É", "ß", "×", "1", "23", "'", "'s", "'t", "'re", "-", ".", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "日", "\u00a0", "\u2003", "e\u0301", "Ж", "İ", "😀", "\r\n", "  ", "\n\n", "the", "World", "\x1c", "ÿ", "Å"]


@pytest.mark.parametrize("name", [tokens.COUNTED, packing.VOCABULARY])
def test_encoder_equals_the_library(name):
    rng, code = random.Random(2), tokens.encoder(name)

    def same(texts, **how):
        want = [e.ids for e in code.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        for first, raw, offsets in tokens.runs(pa.array(texts, pa.string()), 50_000):
            ids, n = code.encoded(raw, offsets, **how)
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want[first : first + len(n)]

    same(["".join(rng.choices(PARTS, k=rng.randrange(30))) for _ in range(5000)] + [None, ""])
    long = ["".join(rng.choices(PARTS, k=2000)) for _ in range(40)]
    same([*long, "ab cd\n" * 900, "a" * 5000, " " * 5000 + "x", "日" * 3000], size=300, overlap=80)  # spliced, some only after widening


def test_token_counts(docs, none):
    tok = tokens.encoder(tokens.COUNTED).tok
    for r in tokens.counts(docs).collect():
        text = next(t for i, t, _ in ROWS if i == r["doc_id"]) or ""
        assert (r["n_tokens"], r["n_bytes"]) == (len(tok.encode(text, add_special_tokens=False).ids), len(text.encode()))
    assert tokens.counts(none).count() == 0


def test_packing(spark, docs, none):
    rows = packing.packed(spark, docs, 64).collect()
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq in places.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= 64
    assert len({r["doc_id"] for r in rows}) == 7 and packing.packed(spark, none).count() == 0
    rng = random.Random(3)
    hist = {rng.randrange(1, 2049): rng.randrange(1, 40) for _ in range(300)}
    used = {}
    plan = packing.planned(hist)
    for lengths, n in plan:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == hist
    assert sum(n for _, n in plan) <= 1.02 * max(sum(x * n for x, n in hist.items()) / 2048, sum(n for x, n in hist.items() if x > 1024)) + 2


def test_span_hash(docs, none):
    rows = span_hash.compared(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == len(ROWS) and by[1][0]["n_chars"] == 0 and by[8][0]["n_chars"] == 7
    assert by[8][0]["edited_sha256"] == hashlib.sha256("é 😀 ".encode()).hexdigest()  # followed by the first, which is empty
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] and by[1][0]["near_next"] == 1.0
    assert span_hash.compared(none).count() == 0
    powers, text = span_hash.Powers(), "abcabcabdabcab"
    s = span_hash.Spans(powers, span_hash.codes(text))
    for a in range(len(text)):
        for b in range(len(text)):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert span_hash.common_extension(s, a, s, b) == n


def test_language_model(docs, none):
    model = kneser_ney.trained(docs)
    rows = {r["doc_id"]: r for r in kneser_ney.scored(docs, model).collect()}
    assert model.tokens == 30_000 + 5 + 5 + 2 + 3 + 8 and rows[1]["n_tokens"] == 1 and rows[4]["n_known"] == 6
    assert rows[7]["score"] > rows[7]["base_score"]
    assert kneser_ney.scored(none, model).count() == 0
    empty = kneser_ney.trained(none)
    assert {r["n_known"] for r in kneser_ney.scored(docs, empty).collect()} == {0}


def test_toxicity(spark, none):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*rng.choices(plain, k=30), *(["vile", "rotten"] if i % 5 == 0 else [])]), i % 5 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i % 2 == 0], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(spark, docs, labels).collect()}
    assert all((got[i] >= 0.7) == y for i, _, y in rows) and got[9000] < 0.5
    assert toxicity.scores(spark, docs, labels.where("false")).count() == len(got)
    assert toxicity.scores(spark, none, labels).count() == 0


PAGE = "<html><body><div>Home | About</div>{}<div>All rights kept</div></body></html>"


def test_page_text(spark):
    pages = [
        (1, "http://h/a/1", PAGE.format("<p>One  &amp;\n two</p>")),
        (2, "http://h/a/2", PAGE.format("<p>Other text</p>")),
        (3, "http://h/b", "<nav>m</nav><article><h1>T</h1><p>Body <b>bold</b><p>more</article><footer>f</footer>"),
        (4, None, None),
        (5, "http://lone/x", "<p>kept</p><script>var a='<p>'</script><div class='ad'>buy</div>"),
        (6, "http://lone/x", ""),
    ]
    got = {r["page_id"]: r["text"] for r in page_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "One & two", 2: "Other text", 3: "T\nBody bold\nmore", 4: "", 5: "kept", 6: ""}


def test_page_text_aligns_marked_pages(spark):
    teaser = "<div>Home</div><div>{}</div><article>{}</article>"
    article = "<article><p>Press the key</p><p>{0} a</p><p>{0} b</p></article>"
    pages = [
        (1, "http://d/1", teaser.format("main one", "<p>see</p>")),  # main text outside the article
        (2, "http://d/2", teaser.format("main two", "<p>look</p>")),
        (3, "http://e/1", article.format("x")),  # a frame line inside articles
        (4, "http://e/2", article.format("y")),
        (5, "http://f/1", article.format("z")),  # copies
        (6, "http://f/2", article.format("z").replace("z b", "z c")),
    ]
    got = {r["page_id"]: r["text"] for r in page_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == "main one\nsee" and got[2] == "main two\nlook"
    assert got[3] == "x a\nx b" and got[4] == "y a\ny b"
    assert got[5] == "Press the key\nz a\nz b" and got[6] == "Press the key\nz a\nz c"


def test_alignment_of_long_pages():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(40))] for _ in range(2))
        want = [0] * (len(b) + 1)
        for x in a:
            row, old = [0], want
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
            want = row
        for cells in (1, 30, page_text.LONGEST_TABLE):
            got = sorted(page_text.shared(a, b, cells))
            rest = iter(b)
            assert len(got) == want[-1] and all(any(a[i] == y for y in rest) for i in got)
    menu = [0, 1] * 3600  # repeated lines on both sides, over LONGEST_TABLE cells
    assert page_text.shared([7, *menu, 8], [9, *menu, 6]) == set(range(1, len(menu) + 1))
    mixed = [rng.randrange(3) for _ in range(7200)]
    assert len(page_text.shared(mixed, mixed[::-1])) == page_text._lengths(mixed, mixed[::-1])[-1]


def test_pii(spark, docs, none):
    text = "mail a.b@c.org, ip 1.2.3.4 and 1.2.3.999; card 4111 1111 1111 1111 call +1 (555) 010-9999"
    known = [(i, f"zz reach: +1 (555) 010-{1000 + i} yy", "s") for i in range(20, 30)]
    new = [(40, "zz reach: (555) 010-4444 yy", "s"), (41, text, "s"), (42, "plain (555) 010-4444 words", "s")]
    df = spark.createDataFrame([*known, *new], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["spans"] for r in pii.identified(df).collect()}
    assert [(s["kind"], text[s["first"] : s["last"]]) for s in got[41]] == [(0, "a.b@c.org"), (1, "1.2.3.4"), (2, "4111 1111 1111 1111"), (3, "+1 (555) 010-9999")]
    assert [(s["kind"], s["first"], s["base"]) for s in got[40]] == [(3, 10, False)] and got[42] == []
    assert pii.identified(none).count() == 0 and pii.identified(docs).count() == len(ROWS)


def test_pii_counts_are_those_of_the_base(spark, tmp_path):
    rows = [(1, "a@b.cd"), (2, "a@b.cd e@f.gh i@j.kl"), (3, "1.2.3.4 5.6.7.8 then +1 (555) 010-9999"), (4, None), (5, "4111 1111 1111 1111")]
    rows += [(i, f"zz reach: +1 (555) 010-{1000 + i} yy") for i in range(20, 30)] + [(40, "zz reach: (555) 010-4444 yy")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pii.op1_pii(spark, str(tmp_path)).collect()}
    counts = {i: [r[f"n_{k}"] for k in pii.KINDS] for i, r in got.items()}
    assert [counts[i] for i in (1, 2, 3, 4, 5, 20)] == [[1, 0, 0, 0], [3, 0, 0, 0], [0, 2, 0, 1], [0, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    assert counts[40] == [0, 0, 0, 0] and got[40]["n_added"] == 1 and got[40]["spans"] == "phone:10:24"  # an added span leaves the base as it is


def test_pii_rounds_go_on(spark):
    # link n shares the word before with one of its neighbours in the chain and the word after with the other
    rows = [f"aa: +1 (555) 010-{1000 + i}" for i in range(13)]
    for n in range(7):
        before, after = chr(97 + (n + 1) // 2), chr(97 + n // 2)
        rows += [f"{before}{before}: (555) {100 + n}-{1000 + i} z{after}:" for i in range(12 - n)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: len(r["spans"]) for r in pii.identified(df).collect()}
    assert got == {i: 1 for i in range(len(rows))}
    every = common.stored(pii.spans(pii.found(df)), "spans")
    with pytest.raises(RuntimeError):
        pii.bootstrapped(df, every, rounds=4)


def test_ordered_blocks(spark):
    n = 300
    df = spark.createDataFrame([(i * 7,) for i in range(n)], "id long")
    runs = common.ordered_blocks(df, df, "id", 16, before=True).collect()
    own = [r for r in runs if r["copy"] == 0]
    assert len(own) == n
    last = max(r["block"] for r in own)
    for b in {r["block"] for r in own}:
        ids = [r["id"] for r in own if r["block"] == b]
        assert b == last or [r["id"] for r in runs if r["block"] == b and r["copy"] == 1] == [max(ids) + 7]


def test_components_of_chains_hubs_and_rings(spark):
    links = [(i, i + 1) for i in range(10, 30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (200, 201), (300, 300)]
    found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = {i: 10 for i in range(10, 31)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in range(200, 203)}
    assert found == wanted
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
