"""Matches of findings by meaning, known false positives among them, and what findings mention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from ..plans import scratch
from . import similarity

LEAST = 0.75
KNOWN = 0.92


def semantic_matches(queries: DataFrame, corpus: DataFrame, k: int = 5, least: float = LEAST) -> DataFrame:
    """(q, id, score, rank, confidence): of the k rows of corpus(id, u) most alike to each of queries(q, v), those at least as alike as `least`."""
    found = similarity.top_k(queries, corpus, k).where(F.round("score", 9) >= least)
    return found.withColumn("confidence", scores.confidence(F.col("score")))


def known_by_meaning(issues: DataFrame, known: DataFrame, checksums: DataFrame, least: float = KNOWN) -> DataFrame:
    """issues(id, v, issue, description, function_name, file_path) with the nearest of known(q, v), and whether it drops them.

    An issue without any text is not compared and stays. One whose likeness to its nearest known false positive is
    `least` or more goes, with that likeness to four places and the checksum that checksums(function_name, file_path, issue,
    checksum) has for it (empty where it has none).
    """
    written = F.trim(F.concat_ws(" ", F.trim(F.coalesce("issue", F.lit(""))), F.trim(F.coalesce("description", F.lit("")))))
    near = similarity.top_k(known, issues.where(written != "").select("id", F.col("v").alias("u")), 1, turned=True).select("id", F.col("q").alias("known"), F.round("score", 4).alias("score"), (F.round("score", 9) >= least).alias("_gone"))
    one = checksums.groupBy("function_name", "file_path", "issue").agg(F.max("checksum").alias("checksum"))
    out = issues.drop("v").join(near, "id", "left").join(one, ["function_name", "file_path", "issue"], "left")
    gone = F.coalesce("_gone", F.lit(False))
    return out.select(*[c for c in issues.columns if c != "v"], "known", "score", gone.alias("dropped"), F.when(gone, F.coalesce("checksum", F.lit(""))).alias("checksum"))


def mentions(issues: DataFrame) -> DataFrame:
    """(kind, name, id): the base names of files and the normalised functions that issues(id, description, file_path, function_name)
    name in their text or fields, each once. As rows, so that a file that all of them name makes no large group."""
    files = F.array_append(scores.file_paths(F.col("description")), F.col("file_path"))
    functions = F.array_append(scores.function_names(F.col("description")), F.col("function_name"))
    named = F.concat(
        F.transform(files, lambda p: F.struct(F.lit("file").alias("kind"), text.base_name(p).alias("name"))),
        F.transform(functions, lambda f: F.struct(F.lit("function").alias("kind"), text.normal_function(f).alias("name"))),
    )
    each = issues.select("id", F.explode(F.array_distinct(named)).alias("m"))
    return each.select("m.kind", "m.name", "id").where("name IS NOT NULL AND name <> ''").distinct()


#: Rows that may be broadcast; they are counted before, and a shuffled join is used beyond it.
BROADCAST = 1_000_000


def _alike(named: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, names): for each key of named(kind, name, key) all that it names, and the least key that names the same."""
    own = named.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("kind", "name"))).alias("names"))  # an issue's own
    return own.join(own.groupBy("names").agg(F.min(key).alias(name)), "names")


def candidates(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(q, id, files, functions): issues that share a file or a function with each of queries(kind, name, q), and how many of each.

    What is shared is found once for issues that name the same; then their pairs are made without being shuffled or grouped.
    """
    scratch.checkpoints(index.sparkSession)
    asked, known = _alike(queries, "q", "_q").checkpoint(), _alike(index, "id", "_i").checkpoint()
    each = lambda df, c: df.select(c, "names").distinct().select(c, F.explode("names").alias("m"))
    met = each(asked, "_q").join(each(known, "_i"), "m").groupBy("_q", "_i")
    shared = met.agg(F.count_if(F.col("m.kind") == "file").alias("files"), F.count_if(F.col("m.kind") == "function").alias("functions")).checkpoint()
    few = lambda df: F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df
    spread = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, from which many pairs come
    pairs = known.select("id", "_i").repartition(spread).join(few(shared), "_i").join(few(asked.select("q", "_q")), "_q").where("q <> id")
    return pairs.select("q", "id", "files", "functions")


def match_summary(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """(what, n): queries, those with and without matches, matches in all and by confidence."""
    counts = queries.select("q").distinct().join(matches.groupBy("q").agg(F.count("*").alias("n")), "q", "left").fillna(0, ["n"])
    total = counts.agg(F.count("*").alias("queries"), F.count_if(F.col("n") > 0).alias("matched"), F.count_if(F.col("n") == 0).alias("unmatched"), F.sum("n").alias("matches"))
    rows = total.unpivot([], ["queries", "matched", "unmatched", "matches"], "what", "n")
    return rows.unionByName(matches.groupBy(F.concat(F.lit("confidence "), "confidence").alias("what")).agg(F.count("*").alias("n")))
