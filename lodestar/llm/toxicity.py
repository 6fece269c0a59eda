"""Toxicity by non-negative positive-unlabelled learning (operator 5).

A logistic model on hashed words and word beginnings is trained with numpy from confirmed toxic texts (P) and
texts whose labels are not looked at (U), minimising pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)). pi is the share of toxic rows among the training
labels. Labels tell the P rows and pi, nothing else; the score reads the text alone.

The training sample is bounded: at most POSITIVES toxic and UNLABELLED other training rows, the first by a hash of
the id. Scoring covers every text whole.

Defined results: null and empty texts score the model's bias; texts of any length are read whole; repeated rows get a
row each; rows without a label are scored like any other; a
null doc_id belongs to the training fold; without any toxic training row every score is 0; several labels of a
document count as toxic if one is; an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

POSITIVES = 6_000
UNLABELLED = 14_000
BITS = 20
BEGINNINGS = (4, 5, 6)
LEAST_DOCS = 4  # sample texts that have a feature
STEPS = 1_000  # at least
LEAST_Z = 5.0  # standard errors by which its share in P must be above that in U
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
WORD = re.compile(r"\w+")


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def features_of(word: str) -> list[int]:
    """The hashed features of a word: itself and its beginnings."""
    raw = {"=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)}
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in raw]


def features(text: str | None) -> np.ndarray:
    return np.unique(np.array([f for w in set(WORD.findall((text or "").lower())) for f in features_of(w)], np.int32))


def texts_with(part: list[np.ndarray], at_once: int = 500) -> np.ndarray:
    """How many texts have each feature."""
    out = np.zeros(1 << BITS, np.int64)
    for i in range(0, len(part), at_once):
        out += np.bincount(np.concatenate([np.zeros(0, np.int32), *part[i : i + at_once]]), minlength=1 << BITS)
    return out


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, epochs: int = 600, batch: int = 512, rate: float = 0.3, l1: float = 5e-6, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative PU logistic model on presence features."""
    texts = [texts_with(part) for part in (positive, unlabelled)]
    df, share = texts[0] + texts[1], [n / len(part) for n, part in zip(texts, (positive, unlabelled), strict=True)]
    pooled = df / (len(positive) + len(unlabelled))
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / len(positive) + 1 / len(unlabelled)))
    used = np.flatnonzero((df >= LEAST_DOCS) & (share[0] - share[1] >= LEAST_Z * spread))
    at = np.full(1 << BITS, -1, np.int64)
    at[used] = np.arange(len(used))
    rows = [[at[x][at[x] >= 0] for x in part] for part in (positive, unlabelled)]
    w, bias = np.zeros(len(used)), math.log(prior / (1 - prior))
    m, v, mb, vb, t = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    rng = np.random.default_rng(seed)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    rounds = max(epochs, -(-STEPS * batch // (len(positive) + len(unlabelled))))
    for _ in range(rounds):
        order = [rng.permutation(len(part)) for part in rows]
        steps = max(1, (len(rows[0]) + len(rows[1])) // batch)
        for pick in zip(np.array_split(order[0], steps), np.array_split(order[1], steps), strict=True):
            if not len(pick[0]) or not len(pick[1]):
                continue
            grads = []
            for part, own in zip(rows, pick, strict=True):
                idx = np.concatenate([part[i] for i in own] or [np.zeros(0, np.int64)])
                of = np.repeat(np.arange(len(own)), [len(part[i]) for i in own])
                z = bias + np.bincount(of, w[idx], len(own))
                grads.append((idx, of, z))
            (pi_, po, pz), (ui, uo, uz) = grads
            soft = lambda z: np.logaddexp(0, z)
            gap = soft(uz).mean() - prior * soft(pz).mean()  # R_u(-) - pi R_p(-)
            gp_minus, gu = -prior * sigmoid(pz) / len(pz), sigmoid(uz) / len(uz)
            gp = prior * -sigmoid(-pz) / len(pz)
            if gap >= 0:
                gp = gp + gp_minus
            else:  # the corrected risk of the negatives is below zero and counts as zero
                gu = np.zeros_like(gu)
            g = np.bincount(pi_, gp[po], len(w)) + np.bincount(ui, gu[uo], len(w))
            gb = gp.sum() + gu.sum()
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            fix = math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w -= rate * fix * m / (np.sqrt(v) + 1e-8)
            w = np.maximum(w - rate * l1 / (np.sqrt(v) * 10 + 1e-3), 0)  # a feature that marks toxic texts never clears one
            bias -= rate * fix * mb / (math.sqrt(vb) + 1e-8)
    full = np.zeros(1 << BITS, np.float32)
    full[used] = w
    return full, float(bias)


def parted(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists as views of one array: a list of Python numbers would take many times the driver's memory."""
    return np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1]) if len(lists) else []


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list, list, float]:
    """(P texts' features, U texts' features, prior) from labelled rows of the training fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out())
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    key = F.xxhash64("doc_id")
    p = known.where("toxic = 1").orderBy(key, "doc_id").limit(POSITIVES)
    u = known.select("doc_id", F.lit(None).cast("int").alias("toxic")).orderBy(key, "doc_id").limit(UNLABELLED)
    picked = p.select("doc_id", F.lit(1).alias("toxic")).union(u)  # a toxic row may stand on both sides, as the risk wants

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], ["toxic", "f"])

    wide = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", "text")
    with common.small_batches(docs.sparkSession, 500):
        got = wide.mapInArrow(run, "toxic int, f array<int>").toArrow()
    sides = [parted(got.filter(mask).column("f").combine_chunks()) for mask in (pc.is_valid(got.column("toxic")), pc.is_null(got.column("toxic")))]
    return *sides, prior


def scored(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score of every row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    on = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((on, weights[on]))  # at most 2^BITS numbers

    def run(batches):
        with common.returned():
            yield from score(batches)

    def score(batches):
        on, value = shared.value
        table = dict(zip(on.tolist(), value.tolist(), strict=True))
        known: dict[str, tuple] = {}
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                seen: set[int] = set()
                for w in set(WORD.findall((text or "").lower())):
                    f = known.get(w)
                    if f is None:
                        if len(known) > 300_000:
                            known.clear()
                        f = known[w] = tuple(x for x in features_of(w) if x in table)
                    if f:
                        seen.update(f)
                z = bias + math.fsum(table[x] for x in seen)
                out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None) -> DataFrame:
    with common.returned():  # the driver keeps nothing of the sample
        p, u, prior = sample(docs if train_on is None else train_on, labels)
        if not p or not 0 < prior < 1:
            return docs.select("doc_id", F.lit(0.0).alias("score"))
        weights, bias = fit(p, u, prior)
        del p, u
    return scored(docs, weights, bias)


def keep(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score the threshold or more, whatever their doc_id."""
    rows = common.numbered(docs, "toxicity-rows")
    texts = rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))
    found = scores(spark, texts, labels, train_on=rows.select("doc.doc_id", "doc.text"))
    with common.small_batches(spark, 500):
        gone = common.stored(found.where(F.col("score") >= threshold).select(F.col("doc_id").alias("row")), "toxic")
    return common.semi_by(rows, gone, ["row"], "left_anti").select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    labels = common.table(spark, sf_dir, "labels", "doc_id", "toxic")
    return scores(spark, docs, labels).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


ORACLE: dict[str, str] = {}
QUERIES = {"op5_toxicity": op5_toxicity}
