"""Full-text search over several fields: a stored index of stemmed words that is added to, phrases, ranking over all fields.

The index is a folder with two tables. `postings` has a row for each word of a field (term, id, field, pos, gen), in files by a
bucket of the term, so that a search reads the buckets of its own words; `entries` has a row for each change of an entry (id,
gen, n: its words over all fields, null once it is deleted). An addition appends to both under a higher generation. Older
rows of an entry stay until compacted() and are passed over, because only rows of an entry's last generation count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stem import porter
from ..plans import scratch

WORDS = r"[\p{L}\p{N}]+"
#: Distinct words whose stems may be broadcast, and words of queries; they are counted before.
BROADCAST_WORDS = 200_000
BUCKETS = 64
K1, B = 1.2, 0.75


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else df


def terms_of(words: DataFrame, stems: bool = True) -> DataFrame:
    """words(word, ...) with `term` in place of word; each different word is stemmed once."""
    if not stems:
        return words.withColumnRenamed("word", "term")
    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much to do: not to be put into one task
    known = words.select("word").distinct().repartition(spread).withColumn("term", porter(F.col("word")))
    return words.join(_small(known), "word").drop("word")


def bucket_of(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def posted(entries: DataFrame, fields: list[str], stems: bool = True) -> DataFrame:
    """(id, field, pos, term) of entries(id, fields...)."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), split_words(F.col(f)).alias("words")) for f in fields])
    each = entries.select("id", F.explode(parts).alias("p")).select("id", "p.field", F.posexplode("p.words").alias("pos", "word"))
    return terms_of(each, stems)


def add(spark: SparkSession, path: str, entries: DataFrame, fields: list[str], generation: int, stems: bool = True) -> None:
    """Puts entries(id, fields...) in place of what the index has under their ids. Generations must ascend."""
    size = sum((F.size(split_words(F.col(f))) for f in fields), F.lit(0))
    rows = posted(entries, fields, stems).withColumn("gen", F.lit(generation)).withColumn("bucket", bucket_of())
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    entries.select("id", F.lit(generation).alias("gen"), size.cast("long").alias("n")).write.mode("append").parquet(f"{path}/entries")


def remove(spark: SparkSession, path: str, ids: DataFrame, generation: int) -> None:
    """Deletes the entries of ids(id)."""
    ids.select("id", F.lit(generation).alias("gen"), F.lit(None).cast("long").alias("n")).write.mode("append").parquet(f"{path}/entries")


def current(spark: SparkSession, path: str) -> DataFrame:
    """(id, gen, n) of the entries that are there."""
    last = spark.read.parquet(f"{path}/entries").groupBy("id").agg(F.max(F.struct("gen", "n")).alias("e"))
    return last.select("id", "e.gen", "e.n").where("n IS NOT NULL")


def compacted(spark: SparkSession, path: str, to: str) -> None:
    """The index without rows that no longer count, in another folder."""
    entries = current(spark, path)
    rows = spark.read.parquet(f"{path}/postings").join(entries.select("id", "gen"), ["id", "gen"], "left_semi")
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{to}/postings")
    entries.write.parquet(f"{to}/entries")


def phrases(queries: DataFrame, stems: bool = True, whole: bool = True) -> DataFrame:
    """(q, phrase, size, at, term): a phrase for each part of queries(q, query) between white space, however many.

    Signs but the underscore part a phrase's words, words of one character are left out, and parts without words do not count.
    The index parts words at underscores too, so that they stand for neighbours there. With whole=False every
    word is a phrase of its own.
    """
    cleaned = F.filter(F.transform(F.split(F.trim("query"), r"\s+"), lambda g: F.array_join(F.filter(F.split(F.regexp_replace(g, r"[^\p{L}\p{N}_]+", " "), " "), lambda w: F.length(w) > 1), " ")), lambda p: p != "")
    parts = cleaned if whole else F.array_distinct(F.flatten(F.transform(cleaned, split_words)))
    each = queries.select("q", F.posexplode(parts).alias("phrase", "p")).withColumn("w", split_words(F.col("p"))).where(F.size("w") > 0)
    return terms_of(each.select("q", "phrase", F.size("w").alias("size"), F.posexplode("w").alias("at", "word")), stems)


def keyed(wanted: DataFrame) -> DataFrame:
    """(q, phrase, key) of phrases: equal phrases of whatever queries have one key, which is looked up once."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"])  # a phrase's own
    return wanted.groupBy("q", "phrase").agg(F.array_join(words, " ").alias("key"))


def found(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, id, tf): how often the words of each of keys(key) stand side by side in one field."""
    terms = F.split("key", " ")
    wanted = keys.select("key").distinct().select("key", F.size(terms).alias("size"), F.posexplode(terms).alias("at", "term")).checkpoint()
    buckets = [r["b"] for r in wanted.select(bucket_of().alias("b")).distinct().collect()]  # BUCKETS at most
    hits = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets)).join(_small(wanted), "term")
    hits = hits.join(current(spark, path).select("id", "gen"), ["id", "gen"], "left_semi")
    single = hits.where("size = 1").groupBy("key", "id").agg(F.count("*").alias("tf"))
    starts = hits.where("size > 1").groupBy("key", "size", "id", "field", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("n")).where("n = size")
    return single.unionByName(starts.groupBy("key", "id").agg(F.count("*").alias("tf")))


def search(spark: SparkSession, path: str, queries: DataFrame, entries: DataFrame, k: int, where: Column | None = None, stems: bool = True, whole: bool = True) -> DataFrame:
    """The k best entries of each of queries(q, query, ...): q, id, score, rank, by BM25 over phrases and all fields together.

    Queries that are equal but for q are answered once. Any of a query's phrases will do. Words, lengths and frequencies are those of the whole index; `where`, a condition
    on the columns of queries and entries(id, ...), is applied before the k best are taken. Scores are ranked to six decimals,
    ties by id.
    """
    scratch.checkpoints(spark)
    alike = Window.partitionBy(*[c for c in queries.columns if c != "q"])
    members = queries.withColumn("_c", F.min("q").over(alike)).checkpoint()
    queries = members.where("q = _c").drop("_c")
    asked = keyed(phrases(queries, stems, whole)).checkpoint()
    hits = found(spark, path, asked).checkpoint()
    frequency = hits.groupBy("key").agg(F.count("*").alias("df"))
    lengths = current(spark, path)
    size = F.broadcast(lengths.agg(F.count("*").alias("total"), F.avg("n").alias("mean")))  # one row
    idf = F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(1e-6)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    weighed = hits.join(frequency, "key").join(lengths.select("id", "n"), "id").crossJoin(size).select("key", "id", part.alias("part"))
    scores = weighed.join(_small(asked), "key").groupBy("q", "id").agg(F.sum("part").alias("score"))
    if where is not None:
        scores = scores.join(entries, "id").join(_small(queries.drop("query")), "q").where(where).select("q", "id", "score")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 6).desc(), "id"))
    best = scores.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("q", "_c")
    return best.join(members.select("q", "_c"), "_c").select("q", "id", "score", "rank")
