"""What keeps the pipeline's executors small: component rounds in one job, no second set of Python workers, small batches of texts."""

import random

import pytest
from pyspark import SparkContext

import corpus_pipeline
from lodestar.llm import common, exact_dedup, mixing, packing, toxicity


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hub", [0, common.HUB])
def test_component_rounds(spark, monkeypatch, hub):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 40)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(7, 7), (3, 2), (3, 2)]
    rng.shuffle(links)
    names, old = [], common.stored
    monkeypatch.setattr(common, "HUB", hub)
    monkeypatch.setattr(common, "stored", lambda df, name: (names.append(name), old(df, name))[1])
    got = common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["root"] for r in got} == brute(links)
    assert ("stars" in names) == (not hub)  # without hubs a round stores its links alone


def test_no_links(spark):
    assert not common.components(spark.createDataFrame([], "a bigint, b bigint")).count()


def test_driver_rows_need_no_python_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", "one two three"), (2, None, "four five"), (3, "a", None)], "doc_id long, source string, text string")
    docs = common.stored(docs, "given")

    def parallelize(*_, **__):
        raise AssertionError("rows of the driver went through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", parallelize)
    rows, pieces = mixing.mixture(spark, docs)
    assert sorted((r["doc_id"], r["size"]) for r in rows.collect()) == [(1, 3), (2, 2), (3, 0)] and pieces.count()
    assert packing.packed(spark, docs).count() == 3
    rows, pieces = mixing.mixture(spark, docs.where("text IS NULL"))
    assert rows.count() == 1 and not pieces.count()


def test_texts_come_in_small_batches(spark, monkeypatch):
    docs = [(i, "s", f"text number {i % 7}") for i in range(20)]
    docs = common.stored(spark.createDataFrame(docs, "doc_id long, source string, text string"), "given")
    seen, old = {}, common.stored
    rows = lambda: int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    monkeypatch.setattr(common, "stored", lambda df, name: (seen.setdefault(name, rows()), old(df, name))[1])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    toxicity.keep(spark, docs, labels).count()
    assert exact_dedup.keep(spark, docs).count() == 7
    mixing.keep(spark, docs).count()
    packing.packed(spark, docs).count()
    assert all(seen[name] <= most for name, most in (("toxic", 500), ("groups", 500), ("sizes", 500), ("pieces", 2_000)))


def test_results_are_read_in_small_batches(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.unset(name)
    docs = common.stored(spark.createDataFrame([(i, "s", f"text {i % 7}") for i in range(20)], "doc_id long, source string, text string"), "given")
    try:
        for stage in ("exact", "near", "mixed", "packed"):
            spark.conf.unset(name)
            assert getattr(corpus_pipeline, stage)(spark, docs, "").count() and int(spark.conf.get(name)) == 500
        spark.conf.set(name, "100")
        corpus_pipeline.exact(spark, docs, "")
        assert spark.conf.get(name) == "100"  # a smaller size stays
    finally:
        spark.conf.unset(name)


def test_pieces_are_encoded_in_runs_of_a_megabyte(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words of a text " * 9_000) for i in range(12)], "doc_id long, text string").coalesce(1)
    whole = sorted(packing.pieces(docs).collect())
    assert packing.RUN == 1 << 20
    monkeypatch.setattr(packing, "RUN", 4 << 20)
    assert whole == sorted(packing.pieces(docs).collect())
