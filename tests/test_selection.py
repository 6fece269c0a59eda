"""Selection by files, keywords of names, diffs and stores that change, on invented data."""

import json

from pyspark.sql import functions as F

from lodestar.functions.keywords import keywords
from lodestar.operators import matching, selection, store


def test_keywords(spark):
    names = {
        "cllcf::CLLCFusion::insertLocation(ProviderContainer,std::shared_ptr< const LCLocation >) const": ["cllcf", "CLLCFusion", "insertLocation", "ProviderContainer", "LCLocation"],
        "-[CLContext shouldEnableAtTime:]": ["CLContext", "shouldEnableAtTime"],
        "+[A classMethod]": ["A", "classMethod"],
        "[B init:delegate:with:]": ["B", "init", "delegate", "with"],
        "ns::Q<int>::~Q(const T&, unsigned int*, libX::Y)": ["ns", "Q", "Y"],
        "plain": ["plain"],
        "": [],
    }
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", keywords(F.col("n"), ["LIBX"]).alias("k")).collect()
    assert {r["n"]: r["k"] for r in got} == names


def test_locations_of_both_forms(spark):
    docs = [
        (1, json.dumps({"f": {"checksum": "c", "code": [{"file_name": "a.c", "start": 1, "end": 3}, {"file_name": "b.c", "start_line": 4, "end_line": 5}]}, "g": 7, "h": {"code": [{"start": 1}]}})),
        (2, json.dumps({"function_to_location": {"f": [{"file": "a.c", "checksum": "d"}], "k": []}})),
        (3, "{"),
        (4, None),
        (5, "[1]"),
    ]
    got = {r[:] for r in selection.locations(spark.createDataFrame(docs, "id int, j string"), "j").collect()}
    assert got == {(1, "f", "c", "a.c", 1, 3), (1, "f", "c", "b.c", 4, 5), (2, "f", "d", "a.c", None, None)}


def test_names_that_hold_others(spark):
    a, b = ["src/x.c", "x.c", "y", "", "xx.cc"], ["x.c", "src", "z", ""]
    got = {r[:] for r in selection.holding(spark.createDataFrame([(v,) for v in a], "a string"), spark.createDataFrame([(v,) for v in b], "b string")).collect()}
    assert got == {(x, y) for x in a for y in b if y and y in x}
    graph = spark.createDataFrame([("src/x.c", 1), ("x", 2), ("other", 3)], "file string, n int")
    assert {r["n"] for r in selection.touching(graph, spark.createDataFrame([("x.c",)], "file string")).collect()} == {1, 2}


def test_sections_of_diffs(spark):
    diff = "diff --git a/m/x.c b/m/x.c\n--- a/m/x.c\n+++ b/m/x.c\n@@ -1 +1 @@\n-old\n+newer\ndiff --git a/y.md b/y.md\n+++ b/y.md\n+text\ndiff --git a/z.swift b/gen/z.swift\n+++ b/gen/z.swift\n+a"
    lines = spark.createDataFrame([("d", i, v) for i, v in enumerate(diff.split("\n"))], "diff string, pos int, value string")
    pos = lambda df: sorted(r["pos"] for r in df.collect())
    assert pos(selection.diff_of_files(lines, spark.createDataFrame([("y.md",)], "file string"))) == [6, 7, 8]
    assert pos(selection.diff_of_sources(lines)) == [0, 1, 2, 3, 4, 5, 9, 10, 11] and pos(selection.diff_of_sources(lines, excluded=["gen"])) == [0, 1, 2, 3, 4, 5]
    assert [r[:] for r in selection.diff_sizes(lines, 3).collect()] == [("d", "m/x.c", 10), ("d", "y.md", 5)]


def test_accounts_one_by_one(spark):
    known = spark.createDataFrame([(1, "a", "old")], "k int, handle string, kind string")
    asked = spark.createDataFrame([(1, 1, "b", "u"), (2, 2, "c", "u"), (2, 3, "d", "o"), (1, 4, "e", "o")], "k int, seq int, handle string, kind string")
    back, after = store.got_or_created(known, asked, ["k"], "seq")
    assert sorted(r[:] for r in back.collect()) == [(1, 1, "a", "old", False), (1, 4, "b", "u", False), (2, 2, "c", "u", True), (2, 3, "c", "u", False)]
    assert sorted(r[:] for r in after.collect()) == [(1, "e", "o"), (2, "d", "o")]


def test_inserts_and_moves(spark):
    rows = spark.createDataFrame([(1, "High"), (1, "low"), (2, "low")], "a int, s string")
    new = spark.createDataFrame([(2, "high"), (3, "Low")], "a int, s string")
    parents = spark.createDataFrame([(1, 9, 9), (2, 1, 0), (3, 0, 0)], "a int, total long, high long")
    every, after = store.inserted(rows, new, parents, "a", "s", ["high"])
    assert every.count() == 5 and sorted(r[:] for r in after.collect()) == [(1, 9, 9), (2, 2, 1), (3, 1, 0)]
    files = spark.createDataFrame([("f_x_1_analysis", "r/src/x.c"), ("f_y_1_analysis", "r/src/x.c"), ("f_x_2_analysis", "r/lib_src/x.c")], "name string, file_path string")
    got = {r["name"] + r["file_path"]: r["source"] for r in store.moved(files, spark.createDataFrame([("src/x.c",)], "path string")).collect()}
    assert list(got.values()).count("src/x.c") == 1 and got["f_x_1_analysisr/src/x.c"] == "src/x.c"


def test_known_by_meaning(spark):
    issues = spark.createDataFrame([(1, [1.0, 0.0], "t", "d", "f", "x"), (2, [0.0, 1.0], None, None, "f", "x"), (3, [0.9, 0.1], "t", None, "g", "x"), (4, [-1.0, 0.0], "t", "", "f", "x")], "id int, v array<double>, issue string, description string, function_name string, file_path string")
    known = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "q int, v array<double>")
    sums = spark.createDataFrame([("f", "x", "t", "abc")], "function_name string, file_path string, issue string, checksum string")
    got = {r["id"]: (r["known"], r["dropped"], r["checksum"]) for r in matching.known_by_meaning(issues, known, sums).collect()}
    assert got == {1: (7, True, "abc"), 2: (None, False, None), 3: (7, True, ""), 4: (8, False, None)}
