"""What used to grow faster than the input: the same results as plain Python, on inputs with many equal rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import changes, fulltext, matching, selection, similarity, traces
from lodestar.plans import scratch
from lodestar.sources import files, pages


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark):
    scratch.checkpoints(spark)


def test_pages_of_a_stored_table(spark):
    keys = [*range(0, 50, 3), 7, 7, 7, None, None, 1000, -5]
    df = spark.createDataFrame([(k, v) for v, k in enumerate(keys)], "k int, v int")
    for size in (1, 4, 1000):
        got = sorted(((r["page"], r["k"], r["v"]) for r in pages.numbered(df, "k", size).collect()), key=str)
        order = sorted(keys, key=lambda k: (k is not None, k or 0))
        assert got == sorted(((order.index(k) // size, k, v) for v, k in enumerate(keys)), key=str)
    assert pages.numbered(df.where("false"), "k").count() == 0


def test_keyword_matches_of_equal_rows(spark):
    rng = random.Random(1)
    row = lambda i: (i, rng.choice("xy"), [rng.choice("abcdefg") for _ in range(rng.randrange(5))])
    left, right = [row(i) for i in range(80)], [row(i) for i in range(60)]
    want = {}
    for i, f, w in left:
        best = min(((-len({*w} & {*v}), n) for n, g, v in right if g == f and {*w} & {*v}), default=None)
        if best:
            want[i] = (best[1], -best[0])
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} int, file string, words array<string>")
    got = changes.by_keywords(frame(left, "id"), frame(right, "name")).collect()
    assert {r["id"]: (r["name"], r["overlap"]) for r in got} == want and len(got) == len(want)
    many = spark.range(200_000).select("id", F.lit("x").alias("file"), F.array(F.lit("a"), F.lit("b")).alias("words"))  # 80 billion pairs if each row met each
    got = changes.by_keywords(many, many.withColumnRenamed("id", "name")).groupBy("name", "overlap").count().collect()
    assert [r[:] for r in got] == [(0, 2, 200_000)]


def test_candidates_are_counted_by_what_they_name(spark):
    rng = random.Random(2)
    rows = sorted({(rng.choice(["file", "function"]), rng.choice("abcd"), rng.randrange(60)) for _ in range(130)})
    asked = [r for r in rows if r[2] % 10 == 0]
    want = {}
    for k, n, q in asked:
        for j, m, i in rows:
            if (k, n) == (j, m) and i != q:
                want.setdefault((q, i), [0, 0])[k == "function"] += 1
    index = spark.createDataFrame(rows, "kind string, name string, id int")
    found = matching.candidates(spark.createDataFrame(asked, "kind string, name string, q int"), index)
    assert {(r["q"], r["id"]): [r["files"], r["functions"]] for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan  # pairs are not brought together again


@pytest.mark.parametrize("turned", [False, True])
def test_nearest_with_many_copies(spark, monkeypatch, turned):
    rng = np.random.default_rng(3)
    kinds = rng.integers(-2, 3, (12, 4)).astype(float)
    rows = [(int(i), [float(x) for x in kinds[rng.integers(12)]]) for i in rng.permutation(400)]
    asked = [r for r in rows if r[0] % 10 == 0]
    monkeypatch.setattr(similarity, "BLOCK", 7)
    got = similarity.top_k(spark.createDataFrame(asked, "q long, v array<double>"), spark.createDataFrame(rows, "id long, u array<double>"), 3, turned=turned).collect()

    def like(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(1 - (1 - (float(np.dot(a, b)) / n if n else 0.0)) / 2, 9)

    want = set()
    for a, v in rows if turned else asked:
        near = sorted((-like(v, u), b) for b, u in (asked if turned else rows) if a != b)[:3]
        want |= {(b, a, i + 1) if turned else (a, b, i + 1) for i, (_, b) in enumerate(near)}
    assert {(r["q"], r["id"], r["rank"]) for r in got} == want and len(got) == len(want)


def test_best_so_far_stays_small():
    best = similarity._Best(50, 4)
    for i in range(60):
        best.add(np.full((50, 2000), 0.5), np.arange(2000)[::-1] + 2000 * (59 - i))  # copies, the least id last
        assert best.n <= similarity.CELLS
    row, _, ids, _ = best.kept()
    assert len(row) == 200 and set(ids.tolist()) == {0, 1, 2, 3}


def test_paths_of_many_trees(spark):
    trees = [(str(i), '{"frameName":"r","value":3,"children":[' + ",".join('{"frameName":"c%d","value":1}' % j for j in range(i % 4)) + "]}") for i in range(50)]
    df = spark.createDataFrame(trees, "tree string, body string")
    got = {(r["tree"], r["leaf"], r["path"][0]) for r in traces.tree_paths(df).collect()}
    assert got == {(str(i), j, f"c{j}" if i % 4 else "r") for i in range(50) for j in range(max(1, i % 4))}
    assert {(r["tree"], r["path"][0]) for r in traces.tree_paths(df, 2).collect()} == {(str(i), "c2") for i in range(50) if i % 4 == 3}


def test_equal_queries_are_answered_once(spark, tmp_path):
    path = str(tmp_path / "index")
    entries = spark.range(300).select("id", F.concat(F.lit("word w"), F.col("id") % 7).alias("body"))
    fulltext.add(spark, path, entries, ["body"], 1, stems=False)
    asked = spark.range(2000).select(F.col("id").alias("q"), F.when(F.col("id") < 1990, "word").otherwise("word w3").alias("query"))
    found = fulltext.search(spark, path, asked, entries, 2, stems=False, whole=False)
    got = {r["q"]: r["ids"] for r in found.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids")).collect()}
    assert got == {q: [0, 1] if q < 1990 else [3, 10] for q in range(2000)}


def test_partitions_grow_with_the_rows(spark):
    df = spark.range(10_000).select((F.col("id") % 700).alias("k"), "id")
    got = scratch.dealt(df, "k", 500)
    sizes = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.countDistinct("k").alias("k")).collect()
    assert got.rdd.getNumPartitions() == 20 and sum(r["k"] for r in sizes) == 700 and sum(r["n"] for r in sizes) == 10_000


def test_hunks_and_sizes_of_long_sections(spark):
    text = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,2 +3 @@", " same", "-gone", "+new", *["+" + "y" * 9] * 50, "@@ -70,0 +90,4 @@", "+z", "diff --git a/q b/q", "+++ b/q", "@@ -5 +6 @@", "-w"]
    lines = spark.createDataFrame([(1, i, v) for i, v in enumerate(text)], "diff int, pos int, value string")
    found = files.hunks(lines)
    got = sorted((r["hunk"], r["file"], r["old_first"], r["old_last"], r["new_first"], r["new_last"]) for r in found.collect())
    assert got == [(1, "x", 1, 2, 3, 3), (2, "x", 70, 69, 90, 93), (3, "q", 5, 5, 6, 6)]
    assert {(r["file"], r["size"]) for r in selection.diff_sizes(lines).collect()} == {("x", 5 + 4 + 500 + 2), ("q", 2)}
    logical = found._jdf.queryExecution().optimizedPlan().toString()
    below = logical[logical.index("Window [") :]
    assert "Filter" in below or "LocalRelation" in below  # lines without a header go before the window


def test_deep_json_takes_few_jobs(spark):
    """Levels are opened many a round, not one a job."""
    from lodestar.operators import variants

    deep = '{"a":[' * 10 + '{"k":1}' + "]}" * 10
    spark.sparkContext.setJobGroup("deep json", "")
    got = variants.values_of(spark.createDataFrame([(1, deep)], "id int, j string"), "j", "k").collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep json"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r[:] for r in got] == [(1, "$" + ".a[0]" * 10 + ".k", "1")] and jobs < 12
