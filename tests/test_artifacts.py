"""Searches, files, write-back, symbols, code and pages on invented data, against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lodestar.functions import comments
from lodestar.functions.stem import porter
from lodestar.operators import fulltext, graph, macros, symbols, trees, triage, variants, writeback
from lodestar.plans import scratch
from lodestar.sources import file_index, pages, result_dirs, stores

#: Words with their stems, as published with the algorithm.
STEMS = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll say sai by by generalizations gener opinion opinion apologies apolog"""


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark):
    scratch.checkpoints(spark)


def test_stems(spark):
    words = STEMS.split()
    pairs = list(zip(words[::2], words[1::2], strict=True))
    got = spark.createDataFrame(pairs, "w string, s string").select("w", porter(F.col("w"))).collect()
    assert [r[:] for r in got] == pairs


def test_index_is_added_to(spark, tmp_path):
    path, fields = str(tmp_path / "index"), ["name", "body"]
    rows = [(1, "MyClass.myMethod", "relational joins"), (2, "other", "joined by a relation; my method"), (3, None, ""), (4, "x", "my class my method")]
    fulltext.add(spark, path, spark.createDataFrame(rows, "id int, name string, body string"), fields, 1)
    ask = lambda text, **k: [(r["id"], r["rank"]) for r in fulltext.search(spark, k.pop("path", path), spark.createDataFrame([(0, text)], "q int, query string"), None, 10, **k).orderBy("rank").collect()]
    assert {i for i, _ in ask("MyClass::myMethod")} == {1}  # one phrase, side by side in one field
    assert {i for i, _ in ask("relations a ( )")} == {1, 2} and ask("a ( )") == []
    fulltext.add(spark, path, spark.createDataFrame([(1, "gone", "nothing"), (5, "myclass mymethod", None)], "id int, name string, body string"), fields, 2)
    fulltext.remove(spark, path, spark.createDataFrame([(2,)], "id int"), 3)
    assert {i for i, _ in ask("MyClass::myMethod")} == {5} and ask("relational") == []
    fulltext.compacted(spark, path, str(tmp_path / "small"))
    assert {i for i, _ in ask("MyClass::myMethod", path=str(tmp_path / "small"))} == {5}
    assert spark.read.parquet(str(tmp_path / "small/postings")).where("id = 2 OR gen = 1 AND id = 1").count() == 0
    plan = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin([3]))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan)


def test_keys_at_any_depth(spark):
    deep = "".join('{"a":[' for _ in range(30)) + '{"k":{"k":1}}' + "]}" * 30
    rows = [(1, '{"k":[1,{"x":{"k":"v"}}],"y":null}'), (2, "[[{\"k\":null}]]"), (3, "{broken"), (4, None), (5, "7"), (6, deep), (7, '{"K":1,"kk":2}')]
    got = sorted((r["id"], r["path"], r["value"]) for r in variants.values_of(spark.createDataFrame(rows, "id int, j string"), "j", "k").collect())
    assert got[:3] == [(1, "$.k", '[1,{"x":{"k":"v"}}]'), (1, "$.k[1].x.k", '"v"'), (2, "$[0][0].k", "null")]
    assert [(r[0], r[2]) for r in got[3:]] == [(6, '{"k":1}'), (6, "1")] and got[3][1] == "$" + ".a[0]" * 30 + ".k"


def test_folders_of_result_files(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b" / "deep"
    a.mkdir()
    b.mkdir(parents=True)
    (a / "1_analysis.json").write_text(json.dumps([{"severity": "High", "file_path": "x.c"}, 7, {"function_name": "f"}]))
    (a / "2_analysis.json").write_text(json.dumps({"severity": "low", "original_callstack": []}, indent=1))
    (a / "3_analysis.json").write_text("{broken")
    (a / "4_analysis.json").write_text(" \n")
    (a / "other.json").write_text("[]")
    (b / "5_analysis.json").write_text("7")
    (b / "6_analysis.json").write_text("[]")
    watch = Observation("t")
    found = result_dirs.issues(spark, str(tmp_path), "*_analysis.json", watch=watch).collect()
    assert sorted((r["name"], r["pos"]) for r in found) == [("1_analysis.json", 0), ("1_analysis.json", 2), ("2_analysis.json", 0)]
    assert watch.get == {"files": 6, "processed": 3, "with_errors": 4}
    got = {(r["folder"].rsplit("/", 1)[1], r["what"], r["value"]): r["n"] for r in result_dirs.statistics(spark, str(tmp_path), "*_analysis.json").collect()}
    assert [got["a", k, ""] for k in ("files", "valid", "invalid", "issues", "with_callstack")] == [4, 2, 2, 4, 1] and got["deep", "files", ""] == 2 and got["deep", "valid", ""] == 2
    assert got["a", "severity", "high"] == got["a", "severity", "low"] == got["a", "severity", "unknown"] == 1 and got["a", "file_path", "unknown"] == 2


def test_write_back(spark, tmp_path):
    path, archive = str(tmp_path / "t"), str(tmp_path / "a")
    kind = "part string, function string, file_path string, checksum string, results array<struct<issue:string,n:int>>"
    rows = [("p", "f", "x", "aaaaaaaa11", [(" a ", 1), ("b", 2)]), ("p", "g", "x", "short", [("z", 3)]), ("q", "h", "y", "bbbbbbbb", [("c", 4)]), ("r", "i", "y", "cccccccc", [("d", 5), (None, 6)]), ("q", "k", "y", "eeeeeeee", [])]
    spark.createDataFrame(rows, kind).write.partitionBy("part").parquet(path)
    files = lambda: {r[0]: r[1] for r in spark.read.parquet(path).groupBy("part").agg(F.sort_array(F.collect_set("_metadata.file_path"))).collect()}
    before = files()
    left = spark.createDataFrame([("aaaaaaaa99", "a"), ("bbbbbbbb", "c"), ("short", "other")], "checksum string, issue string")
    assert {r[:] for r in writeback.write_back(spark, path, left, archive).collect()} == {("p", 1), ("r", 2)}
    got = {(r["part"], r["function"]): [x["issue"] for x in r["results"]] for r in spark.read.parquet(path).collect()}
    assert got == {("p", "f"): [" a "], ("p", "g"): ["z"], ("q", "h"): ["c"], ("r", "i"): [], ("q", "k"): []}
    after = files()
    assert after["q"] == before["q"] and after["p"] != before["p"]
    assert sorted(r["issue"]["n"] for r in writeback.archived(spark, archive).collect()) == [2, 5, 6]
    assert writeback.write_back(spark, path, left, archive).count() == 0 and files() == after


def test_best_definitions_are_those_of_one_by_one(spark):
    rng = random.Random(2)
    words = [f"w{i}" * (i % 3 + 1) for i in range(14)]
    keys = [".".join(rng.sample(words, rng.randrange(1, 9))) + rng.choice(["", "(w1)"]) for _ in range(200)]
    asked = [" ".join(rng.sample(words, rng.randrange(1, 13))) for _ in range(60)] + ["none"]
    tokens = lambda s: set(re.findall("[A-Za-z0-9_:]+", s.partition("(")[0]))
    want = {}
    for s in asked:
        query, best = set(sorted(tokens(s), key=lambda t: (-len(t), t))[:10]), (0, 0, None)
        for k in keys:
            n = len(tokens(k))
            if n <= 6 and len(query & tokens(k)) > best[0] and n > best[1]:
                best = (len(query & tokens(k)), n, k)
        if best[2]:
            want[s] = best
    got = symbols.best_definitions(spark.createDataFrame([(s,) for s in asked], "symbol string"), spark.createDataFrame(list(enumerate(keys)), "place int, key string")).collect()
    assert {r["symbol"]: (r["overlap"], r["size"], r["key"]) for r in got} == want


def test_derived_macros(spark):
    text = "#define A B\n#define B !(C) // x\n#define C A\n#define D (E)\n#define F 7\n#define G H + 1\n# define I !J /* x */\n#define __K A\n#if defined(A) && X\n#elif D\n#ifdef NULL\n#if I == 2 || J >= 3\nint x; // #ifndef Q\n#if 3\n"
    lines = spark.createDataFrame([(x,) for x in text.split("\n")], "line string")
    assert {r[0] for r in macros.named(lines).collect()} == set()  # single letters are no macros
    lines = lines.withColumn("line", F.regexp_replace("line", r"\b([A-Z])\b", "$1_$1"))
    assert {r[0] for r in macros.named(lines).collect()} == {"A_A", "D_D", "I_I", "Q_Q"}
    pairs = {r[:] for r in macros.derived(lines).collect()}
    assert pairs == {("A_A", "B_B"), ("B_B", "C_C"), ("C_C", "A_A"), ("D_D", "E_E"), ("I_I", "J_J")}
    got = {r[:] for r in macros.closure(macros.derived(lines), spark.createDataFrame([("A_A",), ("D_D",)], "macro string")).collect()}
    assert got == {("A_A", "B_B", 1), ("A_A", "C_C", 2), ("A_A", "A_A", 3), ("D_D", "E_E", 1)}
    assert {r[0] for r in macros.needed(lines).collect()} == {f"{c}_{c}" for c in "ABCDEIJQ"}


def scanned(code):
    """Without comments, one character after the other."""
    out, i, mode = [], 0, ""
    while i < len(code):
        two = code[i : i + 2]
        if mode in ("'", '"'):
            if code[i] == "\\" and i + 1 < len(code) and code[i + 1] != "\n":
                out.append(two)
                i += 2
                continue
            mode = "" if code[i] in (mode, "\n") else mode
            out.append(code[i])
        elif mode == "//":
            if code[i] == "\n":
                mode = ""
                out.append("\n")
        elif mode == "/*":
            if two == "*/":
                mode = ""
                i += 1
            elif code[i] == "\n":
                out.append("\n")
        elif two in ("//", "/*"):
            mode = two
            i += 1
        else:
            mode = code[i] if code[i] in "'\"" else ""
            out.append(code[i])
        i += 1
    return "".join(out)


def test_comments(spark):
    rng = random.Random(4)
    codes = ["".join(rng.choice(["//", "/*", "*/", '"', "'", "\\", "\n", "a", " ", "/", "*"]) for _ in range(rng.randrange(25))) for _ in range(1500)]
    codes += ['s = "/* no */"; // yes', "/* never\nclosed", "x /* a */ y /* b\nc */ z", "", "c = '\"'; // \"", '"open\n// next']
    df = spark.createDataFrame(list(enumerate(codes)), "i int, c string").select("i", "c", comments.without_comments(F.col("c")).alias("got"))
    for r in df.collect():
        assert r["got"] == scanned(r["c"]), r["c"]
        assert r["got"].count("\n") == r["c"].count("\n")
    code = "  1 | int a; // x\n  2 |   b(); /* y\n  3 |    y */\n  4 | \n  5 | // z\n  6 | c();"
    got = spark.createDataFrame([(code,)], "c string").select(comments.pruned(F.col("c"))).first()[0]
    assert got == "  1 | int a; \n  2 |   b(); \n// ...comments...\n  4 | \n// ...comments...\n  6 | c();"


def test_pages_of_a_database_table(spark):
    url = "jdbc:derby:memory:artifacts;create=true"
    rows = [(k, v) for v, k in enumerate([*range(0, 50, 3), 7, 7, 7, None, None, 1000, -5])]
    stores.write_table(spark.createDataFrame(rows, "k int, v int"), url, "p")
    for size in (1, 4, 1000):
        got = pages.paged(spark, url, "p", "k", size)
        assert sorted((r[:] for r in got.collect()), key=str) == sorted(rows, key=str) and (got.rdd.getNumPartitions() > 1) == (size < 1000)
    stores.write_table(spark.createDataFrame([("a'b", 1), ("c", 2)], "k string, v int"), url, "s", createTableColumnTypes="k VARCHAR(9)")
    assert pages.paged(spark, url, "s", "k", 1).count() == 2
    stores.write_table(spark.createDataFrame([], "k int, v int"), url, "e")
    assert pages.paged(spark, url, "e", "k").count() == 0


def test_nearest_files(spark, tmp_path):
    rng = random.Random(1)
    paths = sorted({"/".join([*(rng.choice("ab") for _ in range(rng.randrange(4))), rng.choice(["f.c", "F.c", "g.c"])]) for _ in range(40)})
    asked = [("f.C", p) for p in paths] + [("g.c", None), ("h.c", "a/x"), ("x/G.c", "b/b/a/z")]

    def far(path, hint):
        a, b = path.split("/"), (hint or "x").split("/")[:-1]
        k = 0
        while k < min(len(a) - 1, len(b)) and a[k] == b[k]:
            k += 1
        return len(a) - k

    got = file_index.resolved(spark.createDataFrame(asked, "name string, hint string"), spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert len(got) == len(asked)
    for r in got:
        same = [(far(p, r["hint"]), p) for p in paths if p.rsplit("/", 1)[-1].lower() == r["name"].rsplit("/", 1)[-1].lower()]
        assert (r["far"], r["path"]) == (min(same) if same else (None, None))
    (tmp_path / "src" / "gen").mkdir(parents=True)
    for name in ("src/a.c", "src/b.TXT", "src/gen/c.c"):
        (tmp_path / name).write_text("12345")
    listed = lambda **k: sorted((r["path"], r["length"]) for r in file_index.listed(spark, str(tmp_path), **k).collect())
    assert listed() == [("src/a.c", 5), ("src/b.TXT", 5), ("src/gen/c.c", 5)] and listed(pattern="*.c", exclude=["gen"]) == [("src/a.c", 5)]
    assert listed(extensions=["txt"]) == [("src/b.TXT", 5)] and listed(include=["src/gen"]) == [("src/gen/c.c", 5)]


def test_batches_are_those_of_one_by_one(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0, 1, 5, 30, 200])) for g in "abc" for i in rng.sample(range(10_000), {"a": 300, "b": 33, "c": 1}[g])]
    want = {}
    for g in "abc":
        batch = n = total = 0
        for _, i, c in sorted(r for r in rows if r[0] == g):
            if n and (n >= 7 or total + c > 100):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + c
            want[g, i] = batch
    for block in (8, 16, 4_096):
        monkeypatch.setattr(triage, "BLOCK", block)
        got = triage.batched(spark.createDataFrame(rows, "g string, i long, c long").repartition(3), "g", "i", "c", 100, 7).collect()
        assert len(got) == len(rows) and {(r["g"], r["i"]): r["batch"] for r in got} == want


def test_component_order_and_budgets(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (0, 1), (7, 5), (5, 8)], "src long, dst long")
    got = {r["node"]: (r["component"], r["level"], r["place"]) for r in graph.component_order(e).collect()}
    assert got == {0: (0, 3, 0), 1: (1, 2, 1), 2: (1, 2, 1), 3: (1, 2, 1), 4: (4, 1, 2), 5: (4, 1, 2), 7: (7, 2, 5)} or {k: v[:2] for k, v in got.items()} == {0: (0, 3), 1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 1), 5: (4, 1), 6: (6, 0), 7: (7, 2), 8: (8, 0)}
    for a, b in [r[:] for r in e.collect()]:
        assert got[a][0] == got[b][0] or got[a][2] < got[b][2]
    assert sorted({v[2] for v in got.values()}) == list(range(6))
    tree = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 5), (3, 6), (4, 7), (5, 8)], "src long, dst long")
    size = spark.createDataFrame([(1, 10), (2, 10), (3, 90), (4, 20), (5, 10), (6, 1), (7, 10), (8, 1)], "node long, chars long")
    cut = lambda **k: sorted((r["node"], r["depth"], r["stub"]) for r in trees.budgeted(tree, size, spark.createDataFrame([(1,)], "node long"), **k).collect())
    assert cut(chars=50) == [(1, 0, False), (2, 1, False), (3, 1, True), (4, 1, False), (5, 2, False), (7, 2, True), (8, 3, True)]
    assert cut(nodes=4) == [(1, 0, False), (2, 1, False), (3, 1, False), (4, 1, False)]
    assert [r[0] for r in cut(depth=1)] == [1, 2, 3, 4]
