"""Similarity of vectors and names, and matches behind a gate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def likeness(cos: Column) -> Column:
    """1 - d / 2 for the cosine distance d, held to [0, 2]."""
    return 1 - F.least(F.greatest(1 - cos, F.lit(0.0)), F.lit(2.0)) / 2


def match_class(score: Column) -> Column:
    return F.when(score >= 0.99, "exact").when(score >= 0.85, "semantic").when(score >= 0.70, "related").when(score >= 0.60, "loose").otherwise("none")


#: Queries whose vectors go to every task; more of them are taken in blocks of this size.
BLOCK = 8_192
#: Scores that a task holds at once.
CELLS = 1 << 18


class _Best:
    """The `most` best (score, id) of each query so far, ties by id. Only what can still be among them is kept, CELLS or so at once."""

    def __init__(self, queries: int, most: int):
        self.most, self.least, self.parts, self.n = most, np.full(queries, -1), [], 0

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        near = rounded(score)
        row, col = np.nonzero(near >= self.least[:, None])
        self.parts.append((row, near[row, col], ids[col], score[row, col]))
        self.n += len(row)
        if self.n > CELLS // 4:
            self.kept()

    def kept(self) -> tuple:
        row, near, ids, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -near, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, place = order[place < self.most], row[place < self.most], place[place < self.most]
        last = place == self.most - 1
        self.least[row[last]] = near[order][last]
        self.parts, self.n = [(row, near[order], ids[order], score[order])], 0
        return self.parts[0]


def rounded(score: np.ndarray) -> np.ndarray:
    """Scores of twelve decimals as whole billionths, halves up as Spark rounds them."""
    return (np.rint(score * 1e12).astype(np.int64) + 500) // 1000


def top_k(queries: DataFrame, corpus: DataFrame, k: int, turned: bool = False) -> DataFrame:
    """For queries(q, v) the k rows of corpus(id, u) most alike, all rows compared: q, id, score, rank.

    The corpus stays where it is. Blocks of BLOCK queries are sent to its partitions, where products of matrices of at most CELLS
    numbers score them and each partition keeps its k best of each query; only those are shuffled. With turned=True it is
    each corpus row that gets its k best queries. Scores are ranked to nine decimals, ties by id.
    """
    kinds = {"q": queries.schema["q"].dataType.simpleString(), "id": corpus.schema["id"].dataType.simpleString()}
    q_kind, id_kind = to_arrow_type(queries.schema["q"].dataType), to_arrow_type(corpus.schema["id"].dataType)
    spark, by, tie = queries.sparkSession, ("id", "q") [not turned], ("q", "id")[not turned]
    most = k + 1  # one more than k: a row may meet itself

    def matrix(lists: list) -> np.ndarray:
        m = np.array(lists, float)
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    out = None
    rows = queries.select("q", "v").toLocalIterator()
    while block := [r for _, r in zip(range(BLOCK), rows)]:  # noqa: B905 - ends with the shorter
        block.sort(key=lambda r: r["q"])
        shared = spark.sparkContext.broadcast((np.array([r["q"] for r in block]), matrix([r["v"] for r in block])))

        def run(batches, shared=shared):
            names, left = shared.value
            wide, best = max(1, CELLS // len(names)), _Best(len(names), most)
            row = lambda q, i, s: pa.RecordBatch.from_arrays([pa.array(q.tolist(), q_kind), pa.array(i.tolist(), id_kind), pa.array(s)], ["q", "id", "score"])
            for b in (b.slice(at, wide) for b in batches for at in range(0, b.num_rows, wide)):
                ids = np.array(b.column("id").to_pylist())
                score = np.round(1 - np.clip(1 - left @ matrix(b.column("u").to_pylist()).T, 0, 2) / 2, 12)
                if turned:
                    n = len(names)
                    place = rounded(score) * n + np.arange(n - 1, -1, -1)[:, None]  # different for each query; ties by q
                    j = np.argpartition(place, max(0, n - most), axis=0)[max(0, n - most) :]
                    yield row(names[j].ravel(), np.tile(ids, len(j)), np.take_along_axis(score, j, 0).ravel())
                else:
                    best.add(score, ids)
            if best.parts:
                at, _, ids, score = best.kept()
                yield row(names[at], ids, score)

        got = corpus.select("id", "u").mapInArrow(run, f"q {kinds['q']}, id {kinds['id']}, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = queries.select("q").crossJoin(corpus.select("id")).limit(0).withColumn("score", F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.round("score", 9).desc(), tie))
    return out.where("q <> id").withColumn("rank", rank).where(F.col("rank") <= k)


def name_score(a: Column, b: Column) -> Column:
    """1 for equal names, .7 where one holds the other, else .3 plus .3 times the share of common tokens, or 0."""
    x, y = F.array_distinct(F.split(a, "[_ ]")), F.array_distinct(F.split(b, "[_ ]"))
    both = F.size(F.array_intersect(x, y))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.7).when(both > 0, 0.3 + 0.3 * both / F.greatest(F.size(x), F.size(y))).otherwise(0.0)


def hybrid(candidates: DataFrame, k: int = 5, *, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), least: float = 0.5) -> DataFrame:
    """The k best of each q by the weighted file_score, function_score and score; a file score of 0 rules a pair out."""
    total = sum((F.col(c) * w for c, w in zip(("file_score", "function_score", "score"), weights, strict=True)), F.lit(0.0))
    scored = candidates.where("file_score > 0").withColumn("hybrid", total).where(F.col("hybrid") >= least)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("hybrid", 9).desc(), "id"))
    return scored.withColumn("hybrid_rank", rank).where(F.col("hybrid_rank") <= k)
