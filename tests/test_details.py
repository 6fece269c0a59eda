"""Folders, hunks, frames in arrays, seeds, vector collections and flows, on invented data."""

import json

from pyspark.sql import functions as F

from lodestar.operators import folders, knowledge, traces, trees, vectors
from lodestar.sources import files


def test_folders(spark):
    f = spark.createDataFrame([("a/b/x",), ("a/b/y",), ("a/z",), ("top",)], "path string")
    assert {r[:] for r in folders.folders(f).collect()} == {("a", "a", 1, 3), ("a/b", "b", 2, 2)}
    assert [r["path"] for r in folders.named(f, spark.createDataFrame([("b",), ("x",)], "name string")).collect()] == ["a/b"]
    roots = spark.createDataFrame([("",), ("a",)], "root string")
    got = {r[:] for r in folders.listing(f, roots, 1).collect()}
    assert got == {("", "a", "folder", 1), ("", "top", "file", 1), ("a", "a/b", "folder", 1), ("a", "a/z", "file", 1)}
    assert ("a", "a/b/x", "file", 2) in {r[:] for r in folders.listing(f, roots, 2).collect()}


def test_hunks(spark):
    diff = ["+++ b/x.c", "@@ -3,2 +3,0 @@ f()", "-a", "-b", "@@ -9 +8,2 @@", "-c", "+d", "+e", "--- a/y", "+++ b/y", "@@ -0,0 +1,7 @@"]
    got = [r[:] for r in files.hunks(spark.createDataFrame([("d", i, v) for i, v in enumerate(diff)], "diff string, pos int, value string")).orderBy("hunk").collect()]
    assert got == [("d", "x.c", 1, 3, 4, 3, 2), ("d", "x.c", 2, 9, 9, 8, 9), ("d", "y", 3, 0, -1, 1, 7)]


def test_frames_in_arrays(spark):
    docs = [(1, json.dumps([[{"path": "f", "cost": 3, "ownerName": "o", "sourcePath": "s"}, {"path": "g", "cost": 2}], []])), (2, "[]"), (3, None), (4, "{")]
    got = [r[:] for r in traces.array_frames(spark.createDataFrame(docs, "id int, j string"), "j").orderBy("pos").collect()]
    assert got == [(1, 0, 0, "f", 3, "o", "s"), (1, 0, 1, "g", 2, None, None)]


def test_seeds(spark):
    rows = [("f", "a.c", "// c\n  int f() {\n}", None, 2, "k"), ("g", "a.c", "", None, 0, ""), ("h", "b.c", "x", "budget", 1, ""), (" ", "b.c", "x", None, 1, ""), ("i", "b.c", "y", None, 1, "")]
    nodes = spark.createDataFrame(rows, "function string, file string, source string, omitted string, depth int, checksum string")
    issues = spark.createDataFrame([("f", "a.c"), ("f", "a.c"), ("i", "other.c")], "function string, file string")
    got = {r[:] for r in knowledge.seeded(nodes, issues).select("entity_key", "summary", "checksum").collect()}
    assert got == {("a.c::f", "int f() {; depth 2; defects: 2", "k"), ("b.c::i", "y; depth 1", None)}
    store = spark.createDataFrame([(1, "run"), (2, "Runner"), (3, "x")], "id int, function string")
    asked = spark.createDataFrame([("run",), ("RUN",), ("zz",)], "asked string")
    assert {r[:] for r in knowledge.optimisations(store, asked).collect()} == {("run", 1, "exact"), ("RUN", 1, "like"), ("RUN", 2, "like")}


def test_collection_embeds_once(spark):
    have = spark.createDataFrame([(1, "a"), (2, "b")], "id int, document string").withColumn("hash", vectors.content_hash("document"))
    docs = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "id int, document string")
    new = vectors.to_embed(have, docs)
    assert {r["id"] for r in new.collect()} == {2, 3}
    after = vectors.upserted(have, new)
    assert {(r["id"], r["document"]) for r in after.collect()} == {(1, "a"), (2, "c"), (3, None)} and vectors.to_embed(after, docs).count() == 0


def test_flow_statistics(spark):
    flows = spark.createDataFrame([(1, 2, "sql", 3), (1, 2, "sql", 4), (1, 5, "file", 3)], "source int, sink int, category string, length int")
    got = {(r["what"], r["value"]): r["n"] for r in trees.flow_statistics(flows).collect()}
    assert got == {("flows", ""): 3, ("sources", ""): 1, ("sinks", ""): 2, ("pairs", ""): 2, ("length", "3"): 2, ("length", "4"): 1, ("category", "sql"): 2, ("category", "file"): 1}
    assert trees.flow_statistics(flows.where("false")).where(F.col("n") > 0).count() == 0
