"""Full-text queries: documents are knowledge entries, benchmark passages what is looked up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import stem
from ..operators import fulltext
from ..plans import scratch
from ..plans import stand_ins as t
from ..registry import query

FIELDS = ["summary", "details", "entity_key", "function_name", "file_path"]


def _entries(spark, d):
    """Documents as entries of five fields: the first line, the other lines, and three names."""
    docs = t.table(spark, d, "documents", "doc_id", "text", "lang", "source")
    first = F.substring_index("text", "\n", 1)
    return docs.select(
        F.col("doc_id").alias("id"), "source", "lang", first.alias("summary"), F.substr("text", F.length(first) + 2).alias("details"),
        F.concat("source", F.lit("::"), "lang").alias("entity_key"), F.concat("lang", F.lit("_handler"), F.col("doc_id") % 10).alias("function_name"), F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit(".swift")).alias("file_path"),
    )


ENTRIES_SQL = r"""entries AS (
  SELECT doc_id AS id, source, lang, split_part(text, chr(10), 1) AS summary, substr(text, length(split_part(text, chr(10), 1)) + 2) AS details,
         source || '::' || lang AS entity_key, lang || '_handler' || (doc_id % 10) AS function_name, 'src/' || source || '/' || lang || '.swift' AS file_path FROM documents)"""


def _queries(spark, d):
    """Passages whole, and looked-up names with signs in them."""
    passages = t.table(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("q"), F.col("text").alias("query"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("subject"))
    names = t.table(spark, d, "documents", "doc_id", "source", "lang").where("doc_id % 100 = 0")
    return passages.union(names.select((-1 - F.col("doc_id")).alias("q"), F.concat("source", F.lit("->"), "lang", F.lit("(x) handlers relational")), "source"))


QUERIES_SQL = """queries AS (SELECT item_id AS q, text AS query, 'src' || (item_id % 20) AS subject FROM benchmark
  UNION ALL SELECT -1 - doc_id, source || '->' || lang || '(x) handlers relational', source FROM documents WHERE doc_id % 100 = 0)"""


def _stem_sql() -> str:
    """words(word) to stems(word, term), one step of the published algorithm after the other."""
    v, c, one, two = stem.V, stem.C, stem.ONE, stem.TWO

    def longest(rules: dict, measure: str) -> str:
        cases = ""
        for s in sorted(rules, key=len, reverse=True):
            ends = f"w LIKE '%{s}'" if s != "ion" else "(w LIKE '%sion' OR w LIKE '%tion')"
            cases += f" WHEN {ends} THEN CASE WHEN regexp_matches(left(w, -{len(s)}), '^{measure}') THEN left(w, -{len(s)}) || '{rules[s]}' ELSE w END"
        return f"CASE{cases} ELSE w END"

    steps = [
        "replace(regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g'), 'yy', 'yY')",
        "CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END",
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN regexp_matches(left(w, -3), '^{one}') THEN left(w, -1) ELSE w END WHEN w LIKE '%ed' AND regexp_matches(left(w, -2), '{v}') THEN left(w, -2) || '+' WHEN w LIKE '%ing' AND regexp_matches(left(w, -3), '{v}') THEN left(w, -3) || '+' ELSE w END",
        f"CASE WHEN w NOT LIKE '%+' THEN w WHEN regexp_matches(w, '(at|bl|iz)[+]$') THEN left(w, -1) || 'e' WHEN regexp_matches(left(w, -1), '{stem.DOUBLE}') THEN left(w, -2) WHEN regexp_matches(left(w, -1), '^{c}*{v}+{c}+$') AND regexp_matches(left(w, -1), '{stem.CVC}$') THEN left(w, -1) || 'e' ELSE left(w, -1) END",
        f"CASE WHEN regexp_matches(w, '{v}.*[yY]$') THEN left(w, -1) || 'i' ELSE w END",
        longest(stem.STEP_2, one),
        longest(stem.STEP_3, one),
        longest(dict.fromkeys(stem.STEP_4, ""), two),
        f"CASE WHEN w LIKE '%e' AND (regexp_matches(left(w, -1), '^{two}') OR regexp_matches(left(w, -1), '^{one}') AND NOT regexp_matches(left(w, -1), '{stem.CVC}$')) THEN left(w, -1) ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND regexp_matches(left(w, -1), '^{two}') THEN left(w, -1) ELSE w END",
    ]
    out = "s0 AS (SELECT word, word AS w FROM words)"
    for i, step in enumerate(steps):
        out += f",\ns{i + 1} AS (SELECT word, {step} AS w FROM s{i})"
    return out + f",\nstems AS (SELECT word, CASE WHEN length(word) > 2 THEN replace(w, 'Y', 'y') ELSE word END AS term FROM s{len(steps)})"


def _search_sql(fields: list[str], k: int, stems: bool, whole: bool, where: str, after: str) -> str:
    cols = " UNION ALL ".join(f"SELECT id, '{f}' AS field, regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}]+') AS ws FROM entries" for f in fields)
    cleaned = r"list_filter(list_transform(regexp_split_to_array(trim(query), '\s+'), lambda g: array_to_string(list_filter(string_split(regexp_replace(g, '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda w: length(w) > 1), ' ')), lambda p: p <> '')"
    parts = cleaned if whole else rf"(SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT regexp_extract_all(lower(array_to_string({cleaned}, ' ')), '[\p{{L}}\p{{N}}]+') AS x)) GROUP BY w))"
    vocabulary = "words AS (SELECT DISTINCT word FROM tok UNION SELECT DISTINCT word FROM pw),\n" + (_stem_sql() if stems else "stems AS (SELECT word, word AS term FROM words)")
    return rf"""WITH {ENTRIES_SQL}, {QUERIES_SQL},
tok AS MATERIALIZED (SELECT id, field, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM ({cols})),
ph AS (SELECT q, subject, unnest(p) AS p, generate_subscripts(p, 1) AS phrase FROM (SELECT q, subject, {parts} AS p FROM queries)),
pw AS MATERIALIZED (SELECT q, phrase, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS off FROM (SELECT *, regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}]+') AS w FROM ph)),
{vocabulary},
t AS MATERIALIZED (SELECT id, field, pos, term FROM tok JOIN stems USING (word)), pt AS (SELECT q, phrase, size, off, term FROM pw JOIN stems USING (word)),
st AS (SELECT q, phrase, id, field, pos - off AS start FROM pt JOIN t USING (term) GROUP BY q, phrase, size, id, field, start HAVING count(*) = size),
tf AS (SELECT q, phrase, id, count(*) AS tf FROM st GROUP BY ALL), df AS (SELECT q, phrase, count(*) AS df FROM tf GROUP BY ALL),
n AS (SELECT e.id, count(word) AS n FROM entries e LEFT JOIN tok USING (id) GROUP BY e.id), z AS (SELECT count(*) AS total, avg(n) AS mean FROM n),
sc AS (SELECT q, id, sum(CASE WHEN ln((total - df + 0.5) / (df + 0.5)) > 0 THEN ln((total - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score
  FROM tf JOIN df USING (q, phrase) JOIN n USING (id), z GROUP BY q, id),
r AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, id) AS rank FROM sc JOIN entries USING (id) JOIN queries USING (q) WHERE {where})
SELECT q, id, rank FROM r JOIN entries USING (id) WHERE rank <= {k} AND {after}"""


@query(_search_sql(FIELDS, 10, True, True, "source = subject", "lang IN ('en', 'fr')"))
def search_knowledge(spark, d):
    """Phrases of stemmed words over five fields, by subject; the wanted tags are looked at after the limit.

    The index is made in two additions, of which the second replaces the English entries of the first.
    """
    scratch.checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/knowledge-{uuid.uuid4().hex}"
    entries = _entries(spark, d)
    fulltext.add(spark, path, entries.where("source < 'src3' OR lang = 'en'").withColumn("details", F.when(F.col("lang") == "en", F.lit("draft")).otherwise(F.col("details"))), FIELDS, 1)
    fulltext.add(spark, path, entries.where("source >= 'src3' OR lang = 'en'"), FIELDS, 2)
    best = fulltext.search(spark, path, _queries(spark, d), entries, 10, F.col("source") == F.col("subject"))
    tags = entries.select("id", F.array("lang", "source").alias("tags"))
    return best.join(tags, "id").where(F.arrays_overlap("tags", F.array(F.lit("en"), F.lit("fr")))).select("q", "id", F.col("rank").cast("long").alias("rank"))


@query(_search_sql(["summary", "entity_key", "file_path"], 5, False, False, "true", "true"))
def search_any_word(spark, d):
    """Any word of the query, as it is, in three fields; deleted entries do not count and come back when added again."""
    scratch.checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/traces-{uuid.uuid4().hex}"
    entries, fields = _entries(spark, d), ["summary", "entity_key", "file_path"]
    fulltext.add(spark, path, entries, fields, 1, stems=False)
    fulltext.remove(spark, path, entries.where("lang = 'de'").select("id"), 2)
    fulltext.add(spark, path, entries.where("lang = 'de'"), fields, 3, stems=False)
    fulltext.compacted(spark, path, f"{path}-compacted")
    return fulltext.search(spark, f"{path}-compacted", _queries(spark, d), entries, 5, stems=False, whole=False).select("q", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {ENTRIES_SQL} SELECT source, lang, count(*) AS entries, count(*) FILTER (WHERE regexp_matches(lower(details), '(^|[^\\p{{L}}\\p{{N}}])the($|[^\\p{{L}}\\p{{N}}])')) AS found
FROM entries WHERE lang IN ('en', 'de') AND file_path LIKE 'src/src1%' GROUP BY 1, 2""")
def search_inspector(spark, d):
    """Entries by optional conditions, counted, with those that a search in the index finds among them."""
    scratch.checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/inspector-{uuid.uuid4().hex}"
    entries = _entries(spark, d)
    fulltext.add(spark, path, entries, ["details"], 1, stems=False)
    wanted = spark.createDataFrame([(0, "the")], "q int, query string")
    hit = fulltext.found(spark, path, fulltext.keyed(fulltext.phrases(wanted, stems=False))).select("id").distinct().withColumn("hit", F.lit(1))
    return entries.where("lang IN ('en', 'de') AND file_path LIKE 'src/src1%'").join(hit, "id", "left").groupBy("source", "lang").agg(F.count("*").alias("entries"), F.count("hit").alias("found"))
