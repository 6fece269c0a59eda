"""Queries of many words are looked up to their end."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar import queries
from lodestar.operators import fulltext
from lodestar.plans import scratch


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark):
    scratch.checkpoints(spark)


def passage(i):
    """300 words that stand nowhere, and behind them a word of the second entry and a phrase of the first."""
    return " ".join([f"nowhere{i}x{j}" for j in range(300)] + ["only2", "alpha::beta"])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two documents, and twenty long passages, one for each subject that search_knowledge asks for."""
    at = tmp_path_factory.mktemp("long")
    docs = [(1, "alpha beta\nrest", "en", "src1", 15), (2, "only2 alpha\nmore beta", "fr", "src2", 21)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, passage(i)) for i in range(20)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return str(at), con


@pytest.mark.parametrize("whole", [False, True])
def test_last_words_of_a_query_count(spark, tmp_path, whole):
    path, n = str(tmp_path / "index"), 5000
    entries = spark.range(n).select("id", F.concat(F.lit("word"), "id").alias("body"))
    fulltext.add(spark, path, entries, ["body"], 1, stems=False)
    asked = spark.createDataFrame([(0, " ".join(f"word{i}" for i in range(n)))], "q int, query string")
    got = fulltext.search(spark, path, asked, entries, n, stems=False, whole=whole).collect()
    assert sorted((r["rank"], r["id"]) for r in got) == [(i + 1, i) for i in range(n)]
    assert fulltext.phrases(asked, stems=False, whole=whole).count() == n


def test_any_word_of_long_passages(spark, tables):
    got = sorted(r[:] for r in queries.QUERIES["search_any_word"](spark, tables[0]).select("q", "id", "rank").collect())
    assert got == sorted(tables[1].sql(f"SELECT q, id, rank FROM ({queries.ORACLE['search_any_word']})").fetchall())
    assert [r for r in got if r[0] >= 0] == [(q, i, rank) for q in range(20) for rank, i in enumerate([1, 2], 1)]  # of two entries, so that words of one weigh nothing: by id


def test_phrases_of_long_passages(spark, tables):
    got = sorted(r[:] for r in queries.QUERIES["search_knowledge"](spark, tables[0]).select("q", "id", "rank").collect())
    assert got == sorted(tables[1].sql(f"SELECT q, id, rank FROM ({queries.ORACLE['search_knowledge']})").fetchall())
    assert [r for r in got if r[0] >= 0] == [(1, 1, 1), (2, 2, 1)]  # by subject: the pair side by side in the first, the word in the second
