"""Knowledge stores as tables: recall, upserts with first and last dates, updates, retention, catalogues, phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def learned(store: DataFrame, new: DataFrame, keys: list[str], at: str = "updated_at") -> DataFrame:
    """The latest row of each key; null keys are equal; created_at is the first date of the key."""
    both = store.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("_b"), F.min(at).alias("created_at"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest], "created_at")


def recalled(store: DataFrame, order: list, most: int, **narrow) -> DataFrame:
    """Rows that equal every given value, None left out, the first `most` in order."""
    for c, v in narrow.items():
        store = store if v is None else store.where(F.col(c) == v)
    return store.orderBy(*order).limit(most)


def prior(functions: DataFrame, store: DataFrame, order: list, per: int, total: int) -> DataFrame:
    """Entries of store(name, checksum, ...) for functions(name, checksum): those of the same checksum first, `per` a
    function, and `total` in all, functions by name."""
    both = functions.select("name", F.col("checksum").alias("_now")).join(store, "name").withColumn("fresh", F.col("checksum").eqNullSafe(F.col("_now"))).drop("_now")
    few = both.withColumn("_k", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("fresh"), *order))).where(F.col("_k") <= per)
    return few.orderBy("name", "_k").limit(total).drop("_k")


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the values of changes(key, some columns) that are not null; updated_at is set where anything is."""
    named = [c for c in changes.columns if c != key]
    both = rows.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in named], F.lit(True).alias("_hit")), key, "left")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in named else F.col(c) for c in rows.columns], F.coalesce("_hit", F.lit(False)).alias("updated"))


def with_status(rows: DataFrame, changes: DataFrame, key: str, now: Column) -> DataFrame:
    """rows(key, status, started_at, completed_at) after changes(key, status): running sets the start where there is none,
    completed and failed set the end."""
    both = rows.join(changes.select(key, F.col("status").alias("_s")), key, "left")
    start = F.when((F.col("_s") == "running") & F.col("started_at").isNull(), now).otherwise(F.col("started_at"))
    end = F.when(F.col("_s").isin("completed", "failed"), now).otherwise(F.col("completed_at"))
    return both.withColumn("started_at", start).withColumn("completed_at", end).withColumn("status", F.coalesce("_s", "status")).drop("_s")


def expired(rows: DataFrame, now: Column, days: int = 90) -> Column:
    """Completed and over `days` old; without an end nothing expires."""
    return F.coalesce((F.col("status") == "completed") & (F.col("completed_at") < now - F.make_dt_interval(F.lit(days))), F.lit(False))


def children_of(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """What is left of children once only these parents are."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def catalog_search(entries: DataFrame, words: list[str], text: Column, most: int) -> DataFrame:
    """entries by the share of the words that their text holds, the best `most`; those without any are left out."""
    low = F.lower(text)
    hits = sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    return entries.withColumn("matches", hits).where("matches > 0").withColumn("score", F.col("matches") / F.lit(float(len(words)))).orderBy(F.desc("score"), F.desc("matches"), "id").limit(most)


def catalog_id(value: Column, prefix: str = "CWE-") -> Column:
    """An id with its prefix, whatever case and whether or not it was given."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.upper(F.trim(value)), f"^{prefix}", ""))


def phrase_hits(docs: DataFrame, key: str, fields: list[str], phrases: list[str]) -> DataFrame:
    """(key, phrase, field, n): where the words of a phrase stand one after another in a field, words being runs of letters,
    digits and underscores. One pass over the fields; nothing is shuffled but the counts."""
    words = lambda c: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), "  "), F.lit(" "))
    one = []
    for f in fields:
        for p in phrases:
            sought = f" {'  '.join(p.lower().split())} "  # every word has a space on both sides, so that hits never overlap
            left = F.length(F.replace(words(f), F.lit(sought), F.lit("")))
            one.append(F.struct(F.lit(p).alias("phrase"), F.lit(f).alias("field"), ((F.length(words(f)) - left) / len(sought)).cast("long").alias("n")))
    return docs.select(key, F.explode(F.array(*one)).alias("h")).select(key, "h.*").where("n > 0")


def unseen(records: DataFrame, registry: DataFrame, cols: list[str]) -> DataFrame:
    """records whose sha256 over the columns is not in registry(hash), with it."""
    return records.withColumn("hash", F.sha2(F.to_json(F.struct(*cols)), 256)).join(registry.select("hash"), "hash", "left_anti")


def admitted(events: DataFrame, by: list[str], ts: str, most: int, seconds: int) -> DataFrame:
    """events with `ahead`, how many of the same `by` came in the `seconds` before each, and whether that leaves room; one that
    is exactly `seconds` old has expired. Ties in time count by the order of event_id."""
    w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("ahead", F.count("*").over(w) - 1).withColumn("admitted", F.col("ahead") < most)


def merged(*registries: DataFrame) -> DataFrame:
    """registries(name, places array) as one: all distinct places of a name, sorted."""
    every = registries[0]
    for r in registries[1:]:
        every = every.unionByName(r)
    return every.groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))


def seeded(nodes: DataFrame, issues: DataFrame, confidence: float = 0.3) -> DataFrame:
    """(entity_key, summary, confidence, checksum) of each of nodes(function, file, source, omitted, depth, checksum) that is no stub:
    its first line of code, its depth, and how many of issues(function, file) it has, if any."""
    line = F.trim(F.regexp_extract("source", r"(?m)^[ \t]*(?!//)(\S.*)$", 1))
    whole = nodes.where((F.trim(F.coalesce("source", F.lit(""))) != "") & F.col("omitted").isNull() & (F.trim("function") != "") & (F.trim("file") != "") & (line != ""))
    counts = issues.groupBy("function", "file").agg(F.count("*").alias("_n"))
    both = whole.join(counts, ["function", "file"], "left")
    marker = F.when(F.col("_n") > 0, F.concat(F.lit("defects: "), F.col("_n").cast("string")))
    summary = F.concat_ws("; ", line, F.concat(F.lit("depth "), F.col("depth").cast("string")), marker)
    return both.select(F.concat_ws("::", F.trim("file"), F.trim("function")).alias("entity_key"), summary.alias("summary"), F.lit(confidence).alias("confidence"), F.nullif("checksum", F.lit("")).alias("checksum"))


def optimisations(store: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id, how) of an append-only store(id, function): entries of exactly that function, else those whose function holds
    it, whatever the case of a to z."""
    from . import selection

    names = asked.select("asked").distinct()
    exact = names.join(store, F.col("asked") == F.col("function")).select("asked", "id", F.lit("exact").alias("how"))
    open_ = names.join(exact.select("asked").distinct(), "asked", "left_anti").withColumn("b", F.lower("asked"))
    low = store.withColumn("a", F.lower("function"))
    like = selection.holding(low, open_).join(open_, "b").join(low, "a").select("asked", "id", F.lit("like").alias("how"))
    return exact.unionByName(like)
