"""Sources, functions and streams on invented data."""

import json
import random

from pyspark.sql import functions as F

from lodestar.functions import text as fn
from lodestar.operators import findings, graph, store
from lodestar.sources import files, stores
from lodestar.streaming import events


def test_results_fill_from_wrapper(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"file_path": "x.c", "function": "f", "checksum": "1", "results": [{"issue": "i", "line_number": "7", "file_path": ""}, {"issue": "j", "line_number": "no", "file_path": "y.c"}]}))
    (tmp_path / "b.json").write_text("{broken")
    rows = {r["issue"]: r for r in files.results(spark, str(tmp_path)).collect()}
    assert rows["i"]["file_path"] == "x.c" and rows["i"]["line_number"] == 7
    assert rows["j"]["file_path"] == "y.c" and rows["j"]["line_number"] is None


def test_traces(spark, tmp_path):
    (tmp_path / "t.txt").write_text("50.0% (10) libA run now (a.c)\nnot a frame\n=====\n5% (1) libB stop\n")
    rows = files.traces(spark, str(tmp_path)).orderBy("trace").collect()
    assert [(r["trace"], r["cost"], r["library"], r["function"], r["source"]) for r in rows] == [(0, 10, "libA", "run now", "a.c"), (1, 1, "libB", "stop", "")]


def test_changed_lines(spark):
    diff = ["--- a/x.c", "+++ b/x.c", "@@ -1,3 +10,3 @@", " same", "-old", "+new", "+more", "@@ -9 +30 @@", "+z"]
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(diff)], "diff string, pos int, value string")
    assert sorted((r["line"], r["kind"]) for r in files.changed_lines(df).collect()) == [(11, "added"), (11, "removed"), (12, "added"), (30, "added")]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "src int, dst int")
    assert {(r["node"], r["depth"]) for r in graph.reached(e, spark.createDataFrame([(1,)], "node int")).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_store_and_findings(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, t int, v string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d")], "k int, t int, v string")
    assert {(r["k"], r["v"]) for r in store.upserted(old, new, ["k"], ["t"]).collect()} == {(1, "c"), (2, "b")}
    df = spark.createDataFrame([("", "high", "x"), ("t", None, "")], "a string, b string, c string")
    assert [r[0] for r in df.select(findings.problems("a", "b", "c")).collect()] == [["no title"], ["no category", "bad severity"]]
    assert df.select(fn.base_name(F.lit("a/b.c")), fn.extension(F.lit("a/b.C"))).first()[:] == ("b.c", "c")


def test_stream_counters(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    q = events.counters(events.stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("events")).first()[0] == src.count()


def test_levels_cycles_and_path_counts(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 4), (5, 4), (6, 7), (7, 6), (8, 6), (8, 3)], "src int, dst int")
    level = graph.levels(e)
    assert dict(level.collect()) == {3: 0, 2: 1, 1: 2, 4: 1, 5: 2, 6: 20, 7: 20, 8: 20}
    assert {k: int(v) for k, v in graph.path_counts(e, level).collect()} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1}
    assert graph.levels(e.where("false")).count() == 0


def test_strong_components(spark):
    e = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (0, 1), (7, 5), (5, 8)]
    got = dict(graph.strong_components(spark.createDataFrame(e, "src int, dst int")).collect())
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}


def test_first_kept_is_the_one_by_one_order(spark):
    rng = random.Random(5)
    links = {tuple(rng.sample(range(40), 2)) for _ in range(60)}
    kept: set = set()
    for i in range(40):
        if not any((i, k) in links or (k, i) in links for k in kept):
            kept.add(i)
    got = graph.first_kept(spark.range(40).withColumnRenamed("id", "node"), spark.createDataFrame(list(links), "a long, b long")).collect()
    assert len(got) == 40 and {r["node"] for r in got if r["kept"]} == kept


def test_tables_over_jdbc(spark):
    url = "jdbc:derby:memory:lodestar;create=true"
    stores.write_table(spark.range(100).selectExpr("id AS k", "id * 2 AS v"), url, "t")
    got = stores.read_table(spark, url, "t", key="K", bounds=(0, 99), parts=4)
    assert got.rdd.getNumPartitions() == 4 and got.agg(F.sum("v")).first()[0] == 9900


def test_sinks_and_known_findings(spark, tmp_path):
    (tmp_path / "fp.csv").write_text('checksum,issue_title,issue_description\n# note\nab,"t, u",d\n,none,x\n')
    assert [r[:] for r in stores.known_findings(spark, str(tmp_path / "fp.csv")).collect()] == [("ab", "t, u", "d")]
    issues = spark.createDataFrame([("x.c", "f", "1", "a<b"), ("x.c", "f", "1", "c")], "file_path string, function string, checksum string, issue string")
    stores.write_results(issues, str(tmp_path / "out"))
    assert {r["issue"] for r in files.results(spark, str(tmp_path / "out")).collect()} == {"a<b", "c"}
    stores.write_html(issues, str(tmp_path / "html"), "file_path", "issue")
    assert "<tr><td>x.c</td><td>a&lt;b</td></tr>" in {r[0] for r in spark.read.text(str(tmp_path / "html")).collect()}
