"""Personal data by bootstrapped contextual extraction (operator 1), DataFrame functions only.

Seeds are what the base rules accept: e-mail addresses, IPv4 addresses, card numbers, phone numbers. The words
beside seeds are patterns: (kind, side, word). A pattern's confidence is how often the word stands beside a known
identifier of that kind, of all its occurrences in the corpus. Loosely shaped candidates that the base rules do not
accept (written-out addresses, other separators, IPv6, numbers without a plus) are identifiers if patterns of high
confidence find them; they count as known in the next round and strengthen further patterns. Rounds go on until
nothing is added; candidates are finite, and an error is raised should ROUNDS not be enough.

Offsets are code points: a text is cut at the matches, and lengths of the cuts are summed per document.

Defined results: null text counts as empty; repeated rows get a row each; an empty table gives an empty result;
other columns are ignored. Of candidates that overlap a base span, none is taken; of overlapping candidates, the
first by (start, kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
# The rules of the base, written so that a scan is linear: \G or a lookbehind holds back starts inside a run.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:[\[({]at[\])}]|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+){1,8}+",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![\x20.-]?[0-9])",
    r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
)
HINTS = ("@", None, None, "+", "at", ":", None, None)  # what a text must contain for a rule to be tried
CANDIDATE = 10  # added to the kind of a candidate
CONTEXT = 48  # code points beside a match that are looked at
KEY = r"[^\x20\x09-\x0D0-9+(@\[]+"  # of a word: up to the first digit or opening sign
SUPPORT = 3  # different known identifiers that a pattern needs
CONFIDENCE = 0.5
ROUNDS = 1000  # an error beyond, never a cut


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def accepted(kind: int, hit: Column) -> Column:
    """The base rules' second part."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        parts = F.transform(F.split(hit, "\\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.try_to_number(p, F.lit("999")).cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(hit))
    return n.between(16, 19) & luhn(_digits(hit)) if kind == 2 else n.between(8, 15)


def _matches(text: Column, rule: str, code: int, hint: str | None, valid) -> Column:
    """array<struct<code, i, gap, hit, valid, before, after>> of a rule's matches in order; empty where none."""
    gaps, hits = F.split(text, rule, -1), F.regexp_extract_all(text, F.lit(rule), F.lit(0))
    each = F.transform(
        F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), F.slice(gaps, 2, 1 << 30).alias("next")),
        lambda m, i: F.struct(
            F.lit(code).alias("code"), i.alias("i"), F.char_length(m["gap"]).alias("gap"), m["hit"].alias("hit"),
            F.right(m["gap"], F.lit(CONTEXT)).alias("before"), F.left(m["next"], F.lit(CONTEXT)).alias("after"),
        ),
    )
    each = F.transform(F.filter(each, lambda m: m["hit"].isNotNull()), lambda m: m.withField("valid", valid(m["hit"])))
    there = F.regexp_like(text, F.lit(rule))
    if hint:
        there = F.contains(text, F.lit(hint)) & there
    return F.when(there, each)


def found(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, items): all matches of each row's whole text, stored once so that texts are read once."""
    text = F.coalesce("text", F.lit(""))
    arrays = [_matches(text, r, k, HINTS[k], lambda h, k=k: accepted(k, h)) for k, r in enumerate(BASE)]
    arrays += [_matches(text, r, k + CANDIDATE, HINTS[k + 4], lambda h: F.lit(True)) for k, r in enumerate(LOOSE)]
    items = F.flatten(F.array_compact(F.array(*arrays)))
    out = docs.select("doc_id", items.alias("items")).withColumn("uid", F.monotonically_increasing_id())
    return common.stored(out, "identifiers")


def spans(rows: DataFrame) -> DataFrame:
    """(uid, code, first, last, hit, before, after) with code-point offsets, end exclusive; valid matches only."""
    one = rows.select("uid", F.explode("items").alias("m")).select("uid", "m.*")
    ahead = Window.partitionBy("uid", "code").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = one.withColumn("last", F.sum(F.col("gap") + F.char_length("hit")).over(ahead)).withColumn("first", F.col("last") - F.char_length("hit"))
    before = F.regexp_extract(F.lower("before"), rf"({KEY})\x20*$", 1)
    after = F.regexp_extract(F.lower("after"), rf"^\x20*({KEY})", 1)
    return one.where("valid").select("uid", "code", "first", "last", F.lower("hit").alias("hit"), before.alias("before"), after.alias("after"))


def patterns_of(instances: DataFrame) -> DataFrame:
    """(kind, side, word, hit) per instance and side."""
    sides = F.array(F.struct(F.lit("<").alias("side"), F.col("before").alias("word")), F.struct(F.lit(">").alias("side"), F.col("after").alias("word")))
    return instances.select("*", F.explode(sides).alias("p")).select("*", "p.side", "p.word").drop("p").where("word <> ''")


def occurrences(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n): how often each of words(word) stands in the whole corpus."""
    keys = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?:^|(?<=[\x20\x09-\x0D]))({KEY})"), F.lit(1))
    return common.semi_by(docs.select(F.explode(keys).alias("word")), words, ["word"]).groupBy("word").agg(F.count("*").alias("n"))


def bootstrapped(docs: DataFrame, all_spans: DataFrame, *, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """The candidates among all_spans that patterns accept: (uid, kind, first, last)."""
    base = all_spans.where(F.col("code") < CANDIDATE).withColumn("kind", F.col("code"))
    loose = all_spans.where(F.col("code") >= CANDIDATE).withColumn("kind", F.col("code") - CANDIDATE)
    clash = base.select(F.col("uid").alias("u"), F.col("first").alias("a"), F.col("last").alias("z"))
    loose = loose.join(clash, (F.col("uid") == F.col("u")) & (F.col("first") < F.col("z")) & (F.col("a") < F.col("last")), "left_anti")
    columns = ["uid", "kind", "first", "last", "hit", "before", "after"]
    loose, known = common.stored(loose.select(columns), "candidates"), base.select(columns)
    none = loose.where(F.lit(False)).select("uid", "kind", "first", "last")
    if loose.isEmpty():
        return none
    # a word that stands beside too few identifiers and candidates together can never be a pattern
    able = patterns_of(known.unionByName(loose)).groupBy("kind", "side", "word").agg(F.countDistinct("hit").alias("d")).where(F.col("d") >= support)
    words = common.stored(able.select("word").distinct(), "context-words")
    if words.isEmpty():
        return none
    seen = common.stored(occurrences(docs, words), "context-counts")
    added = none
    for _ in range(rounds):
        graph = patterns_of(known).groupBy("kind", "side", "word").agg(F.count("*").alias("m"), F.countDistinct("hit").alias("d"))
        trusted = graph.where(F.col("d") >= support).join(seen, "word").withColumn("conf", F.col("m") / F.greatest("m", "n")).where(F.col("conf") >= confidence)
        hits = patterns_of(loose).join(trusted.select("kind", "side", "word", "conf"), ["kind", "side", "word"])
        score = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9)))))
        new = hits.groupBy("uid", "kind", "first", "last").agg(score.alias("score")).where(F.col("score") >= confidence).drop("score")
        new = new.join(added, ["uid", "kind", "first", "last"], "left_anti")
        new = common.stored(loose.join(new, ["uid", "kind", "first", "last"], "left_semi"), "discovered")
        if new.isEmpty():
            break
        added = added.unionByName(new.select("uid", "kind", "first", "last"))
        known = known.unionByName(new)
    else:
        raise RuntimeError(f"bootstrapping did not settle in {rounds} rounds")
    apart = Window.partitionBy("uid").orderBy("first", "kind").rowsBetween(Window.unboundedPreceding, -1)
    return added.withColumn("_z", F.max("last").over(apart)).where("_z IS NULL OR first >= _z").drop("_z")


def identified(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, base and added spans as arrays of (kind, first, last), sorted."""
    rows = found(docs)
    every = common.stored(spans(rows), "spans")
    more = bootstrapped(docs, every, **how)
    whole = every.where(F.col("code") < CANDIDATE).select("uid", F.col("code").alias("kind"), "first", "last", F.lit(True).alias("base"))
    whole = whole.unionByName(more.withColumn("base", F.lit(False)))
    each = whole.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("kind", "first", "last", "base"))).alias("spans"))
    return rows.select("uid", "doc_id").join(each, "uid", "left").withColumn("spans", F.coalesce("spans", F.array().cast(each.schema["spans"].dataType))).drop("uid")


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["first"], s["last"])), ",")


def _count(spans: Column, kind: int) -> Column:
    """How many of a kind. F.filter gives a function of two parameters each element's index as the second, defaults included."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    each = identified(docs)
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count(base, k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return each.select("doc_id", *counts, F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"), added)


ORACLE: dict[str, str] = {}
QUERIES = {"op1_pii": op1_pii}
