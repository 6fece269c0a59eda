"""Queries on scalar functions over parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as fn
from ..plans import stand_ins as t
from ..registry import query

PAIRS = """p AS (SELECT p_partkey AS k, (p_partkey % 101) / 100.0::DOUBLE AS s, 'src/m' || (p_partkey % 3) || '/d' || (p_partkey % 4) || '/f' || (p_partkey % 5) || '.c' AS a,
CASE WHEN p_partkey % 11 = 0 THEN 'f' || (p_partkey % 5) || '.c' ELSE 'src/m' || (p_partkey % 2) || '/d' || (p_partkey % 3) || '/f' || (p_partkey % 6) || '.c' END AS b,
'-get_part' || (p_partkey % 7) || CASE WHEN p_partkey % 3 = 0 THEN 'Handler' ELSE '' END AS x, 'get_part' || (p_partkey % 9) || CASE WHEN p_partkey % 4 = 0 THEN '_more' ELSE '' END AS y FROM part)"""


def pairs(spark, d):
    k = F.col("p_partkey")
    m = lambda n: (k % n).cast("string")
    path = lambda *n: F.concat(F.lit("src/m"), m(n[0]), F.lit("/d"), m(n[1]), F.lit("/f"), m(n[2]), F.lit(".c"))
    bare = F.concat(F.lit("f"), m(5), F.lit(".c"))
    return t.table(spark, d, "part", "p_partkey").select(
        k.alias("k"), ((k % 101) / F.lit(100.0)).alias("s"), path(3, 4, 5).alias("a"), F.when(k % 11 == 0, bare).otherwise(path(2, 3, 6)).alias("b"),
        F.concat(F.lit("-get_part"), m(7), F.when(k % 3 == 0, "Handler").otherwise("")).alias("x"), F.concat(F.lit("get_part"), m(9), F.when(k % 4 == 0, "_more").otherwise("")).alias("y"),
    )


@query(f"""WITH {PAIRS} SELECT k, CASE WHEN s >= .95 THEN 'very_high' WHEN s >= .85 THEN 'high' WHEN s >= .75 THEN 'medium' WHEN s >= .65 THEN 'low' ELSE 'very_low' END AS confidence,
trunc(s * 100)::INT || '%' AS percent, CASE WHEN s >= .9 THEN 'high' WHEN s >= .7 THEN 'medium' ELSE 'low' END AS three_steps FROM p""")
def scalar_confidence(spark, d):
    s = F.col("s")
    return pairs(spark, d).select("k", scores.confidence(s).alias("confidence"), scores.percent(s).alias("percent"), scores.scale(s, [(0.9, "high"), (0.7, "medium")], "low").alias("three_steps"))


@query(f"""WITH {PAIRS} SELECT k, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN .4::DOUBLE * s + .25::DOUBLE * s + .35::DOUBLE * s WHEN k % 2 = 0 THEN .5::DOUBLE * s + .5::DOUBLE * s WHEN k % 3 = 0 THEN .4::DOUBLE * s + .6::DOUBLE * s ELSE s END AS hybrid FROM p""")
def scalar_redistributed_weights(spark, d):
    s, k = F.col("s"), F.col("k")
    return pairs(spark, d).select("k", scores.redistributed(s, s, s, k % 2 == 0, k % 3 == 0).alias("hybrid"))


FOLDERS = "list_distinct(list_filter(string_split({0}, '/')[:-2], lambda v: v <> ''))"
SHARE = "len(list_intersect({0}, {1}))::DOUBLE / greatest(len({0}), len({1}), 1)"


@query(f"""WITH {PAIRS}, q AS (SELECT *, {FOLDERS.format('a')} AS fa, {FOLDERS.format('b')} AS fb, list_distinct(string_split(a, '/')) AS ea, list_distinct(string_split(b, '/')) AS eb, string_split(a, '/')[-1] AS na, string_split(b, '/')[-1] AS nb FROM p)
SELECT k, CASE WHEN na <> nb THEN 0 WHEN a = b THEN 1 ELSE .8::DOUBLE + .2::DOUBLE * {SHARE.format('fa', 'fb')} END AS file_score,
CASE WHEN a = b THEN 1 WHEN na = nb THEN CASE WHEN len(fa) = 0 AND len(fb) = 0 THEN 1 ELSE .8::DOUBLE + .2::DOUBLE * {SHARE.format('fa', 'fb')} END WHEN contains(a, '/') AND regexp_replace(a, '/[^/]*$', '') = regexp_replace(b, '/[^/]*$', '') THEN .4::DOUBLE ELSE .2::DOUBLE * {SHARE.format('ea', 'eb')} END AS path_score FROM q""")
def scalar_path_scores(spark, d):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, d).select("k", scores.file_name_score(a, b).alias("file_score"), scores.path_score(a, b).alias("path_score"))


@query(f"""WITH {PAIRS}, n AS (SELECT k, lower(regexp_replace(regexp_replace(x, '^[-+]\\s*', ''), '(WithOptions|Handler|Callback)$', '')) AS x, lower(regexp_replace(regexp_replace(y, '^[-+]\\s*', ''), '(WithOptions|Handler|Callback)$', '')) AS y FROM p),
q AS (SELECT *, list_distinct(list_concat(regexp_extract_all(x, '[a-z]+'), string_split(x, '_'))) AS p, list_distinct(list_concat(regexp_extract_all(y, '[a-z]+'), string_split(y, '_'))) AS r FROM n)
SELECT k, x AS normal, array_to_string(list_sort(p), ',') AS tokens, CASE WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN .7::DOUBLE WHEN len(list_intersect(p, r)) > 0 THEN .3::DOUBLE + .3::DOUBLE * len(list_intersect(p, r)) / greatest(len(p), len(r)) ELSE 0 END AS score FROM q""")
def scalar_function_names(spark, d):
    x, y = F.col("x"), F.col("y")
    return pairs(spark, d).select("k", fn.normal_function(x).alias("normal"), F.array_join(F.array_sort(fn.name_tokens(fn.normal_function(x))), ",").alias("tokens"), scores.function_score(x, y).alias("score"))


@query("""SELECT p_partkey, regexp_extract_all(split_part('ns::' || replace(p_name, ' ', '_') || '::run' || (p_partkey % 5) || '(int a)', '(', 1), '[A-Za-z0-9_:]+')[1] AS symbol,
'run' || (p_partkey % 5) AS base, replace(p_name, ' ', '.') || '.c' AS file FROM part""")
def scalar_symbols(spark, d):
    p = t.table(spark, d, "part", "p_partkey", "p_name")
    full = F.concat(F.lit("ns::"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("::run"), (F.col("p_partkey") % 5).cast("string"), F.lit("(int a)"))
    path = F.concat(F.lit("../x/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".c"))
    return p.select("p_partkey", F.get(fn.symbol_tokens(full), F.lit(0)).alias("symbol"), fn.unqualified(full).alias("base"), fn.base_name(path).alias("file"))


@query("""SELECT p_type, array_to_string(list_transform(list_filter(string_split(regexp_replace(lower(p_type), ' ', '_', 'g'), '_'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS readable, count(*) AS n FROM part GROUP BY 1""")
def scalar_readable_types(spark, d):
    types = t.table(spark, d, "part", "p_type").groupBy("p_type").agg(F.count("*").alias("n"))
    return types.select("p_type", fn.readable_type(F.regexp_replace(F.lower("p_type"), " ", "_")).alias("readable"), "n")


@query(f"""WITH {PAIRS} SELECT k, ltrim('../' || a, './') AS relative, regexp_replace(b, '/[^/]*$', '') AS cut, a = b OR ends_with(a, b) OR ends_with(b, a) AS same,
left(regexp_replace(a || ':' || x, '[^A-Za-z0-9_.-]', '_', 'g'), 20) AS safe FROM p WHERE contains(b, '/') OR ends_with(a, b)""")
def scalar_paths(spark, d):
    a, b = F.col("a"), F.col("b")
    kept = pairs(spark, d).where(F.contains(b, F.lit("/")) | F.endswith(a, b))
    folder = F.when(fn.folder(b) == ".", b).otherwise(fn.folder(b))
    return kept.select("k", fn.relative(F.concat(F.lit("../"), a)).alias("relative"), folder.alias("cut"), fn.same_file(a, b).alias("same"), fn.file_safe(F.concat(a, F.lit(":"), F.col("x")), 20).alias("safe"))


@query(f"""WITH {PAIRS}, s AS (SELECT k, string_split(a, '/') AS x, string_split(b, '/') AS y FROM p)
SELECT k, len(x) + len(y) - 2 * coalesce(list_max(list_filter(range(0, least(len(x), len(y)) + 1), lambda n: x[1:n] = y[1:n])), 0) AS distance FROM s""")
def scalar_path_distance(spark, d):
    return pairs(spark, d).select("k", scores.path_distance(F.col("a"), F.col("b")).alias("distance"))


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS lines, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda v, i: lpad(i::VARCHAR, 5, ' ') || ' | ' || v), chr(10))) AS numbered, md5(text) AS bare, true AS has_numbers FROM documents""")
def scalar_line_numbers(spark, d):
    docs = t.table(spark, d, "documents", "doc_id", "text").withColumn("n", fn.numbered_lines(F.col("text")))
    return docs.select("doc_id", F.size(F.split("text", "\n")).alias("lines"), F.md5("n").alias("numbered"), F.md5(fn.bare_lines(F.col("n"))).alias("bare"), fn.has_numbers(F.col("n")).alias("has_numbers"))


@query("""WITH v AS (SELECT event_id AS k, event_id % 400 AS a, event_id % 37 * 11 AS b FROM events) SELECT k, CASE WHEN k % 3 = 1 THEN least(a, b) WHEN k % 3 = 0 THEN a END AS lo, CASE WHEN k % 3 = 1 THEN greatest(a, b) WHEN k % 3 = 0 THEN a END AS hi FROM v""")
def scalar_line_ranges(spark, d):
    k = F.col("event_id")
    a, b = (k % 400).cast("string"), (k % 37 * 11).cast("string")
    value = F.when(k % 3 == 0, a).when(k % 3 == 1, F.concat(a, F.lit(" - "), b)).otherwise(F.concat(F.lit("line"), a))
    return t.table(spark, d, "events", "event_id").select(k.alias("k"), fn.line_range(value).alias("r")).select("k", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped, left(sha256(concat(source, '|', text, '|', lang, '|')), 16) AS content,
left(md5(source || ':' || (doc_id % 9) || '-' || (doc_id % 9 + 5) || ':' || lang), 16) AS identity, length(text) // 4 AS tokens, left(text, 10) || '...' AS cut FROM documents""")
def scalar_hashes(spark, d):
    docs = t.table(spark, d, "documents", "doc_id", "text", "lang", "source")
    k = F.col("doc_id") % 9
    return docs.select(
        "doc_id", F.md5(fn.html_escaped(F.col("text"))).alias("escaped"), fn.content_hash(F.col("source"), F.col("text"), F.col("lang"), F.lit(None).cast("string")).alias("content"),
        fn.range_checksum(F.col("lang"), F.col("source"), k, k + 5).alias("identity"), fn.token_estimate(F.col("text")).alias("tokens"), F.concat(F.left("text", F.lit(10)), F.lit("...")).alias("cut"),
    )


@query("""SELECT user_id, '["' || array_to_string(list_sort(list(DISTINCT event_type)), '","') || '"]' AS tags, array_to_string(list_reverse(list_sort(list(DISTINCT event_type))), '>') AS backwards FROM events GROUP BY 1""")
def scalar_tags(spark, d):
    tags = t.table(spark, d, "events", "user_id", "event_type").groupBy("user_id").agg(F.collect_list(F.concat(F.lit(" "), "event_type")).alias("raw"), F.collect_set("event_type").alias("types"))
    return tags.select("user_id", fn.tag_list(F.col("raw")).alias("tags"), F.array_join(F.reverse(F.array_sort("types")), ">").alias("backwards"))


@query("""WITH s AS (SELECT user_id, list_transform(list_sort(list({'t': ts, 'e': event_id, 'v': event_type})), lambda x: x.v) AS p FROM events GROUP BY 1)
SELECT user_id, len(p) AS steps, array_to_string(list_transform(range(1, len(p)), lambda i: p[i] || '>' || p[i + 1]), ' ') AS edges FROM s""")
def scalar_path_edges(spark, d):
    path = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    walks = t.table(spark, d, "events", "user_id", "ts", "event_id", "event_type").groupBy("user_id").agg(path.alias("p"))
    return walks.select("user_id", F.size("p").alias("steps"), F.array_join(F.transform(fn.edges_of(F.col("p")), lambda e: F.concat(e["src"], F.lit(">"), e["dst"])), " ").alias("edges"))


@query("""SELECT user_id, floor(epoch(max(ts) - min(ts)))::BIGINT AS seconds, floor(epoch(CASE WHEN count(*) % 2 = 0 THEN max(ts) ELSE TIMESTAMP '2030-01-01' END - min(ts)))::BIGINT AS open_seconds, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS recent FROM events GROUP BY 1""")
def scalar_dates(spark, d):
    e = t.table(spark, d, "events", "user_id", "ts")
    newest = F.broadcast(e.agg(F.max("ts").alias("m")))
    span = lambda z: F.expr(f"timestampdiff(SECOND, min(ts), {z})")
    end = "CASE WHEN count(*) % 2 = 0 THEN max(ts) ELSE TIMESTAMP_NTZ '2030-01-01 00:00:00' END"
    iso = F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("first")
    return e.crossJoin(newest).groupBy("user_id").agg(span("max(ts)").alias("seconds"), span(end).alias("open_seconds"), iso, F.count_if(F.col("ts") >= F.col("m") - F.expr("INTERVAL 7 DAY")).alias("recent"))


@query("""WITH c AS (SELECT o_custkey AS repo, o_orderkey AS c_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' +0000' AS said FROM orders)
SELECT repo, max_by(c_id, {'t': strptime(left(said, 19), '%Y-%m-%d %H:%M:%S'), 'c': c_id}) AS c_id FROM c WHERE strptime(left(said, 19), '%Y-%m-%d %H:%M:%S') <= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY GROUP BY 1""")
def scalar_commit_as_of(spark, d):
    """The last commit of each repository thirty days before a date."""
    o = t.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000"))
    c = o.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("c_id"), F.to_timestamp_ntz(F.left(at, F.lit(19)), F.lit("yyyy-MM-dd HH:mm:ss")).alias("at"))
    return c.where("at <= TIMESTAMP_NTZ '1998-01-01 00:00:00' - INTERVAL 30 DAY").groupBy("repo").agg(F.max_by("c_id", F.struct("at", "c_id")).alias("c_id"))


REPORT = "'see File: src/m' || (p_partkey % 4) || '/a.c, in lib/b' || (p_partkey % 3) || '.py calling run_' || (p_partkey % 5) || ' and Function: step' || (p_partkey % 2) || '() then if() { x }'"


@query("""SELECT p_partkey, '/b' || (p_partkey % 3) || '.py,/m' || (p_partkey % 4) || '/a.c,lib/b' || (p_partkey % 3) || '.py,src/m' || (p_partkey % 4) || '/a.c' AS files, 'run_' || (p_partkey % 5) || ',step' || (p_partkey % 2) AS functions FROM part""")
def scalar_extracted_names(spark, d):
    text = F.expr(REPORT)
    p = t.table(spark, d, "part", "p_partkey")
    return p.select("p_partkey", F.array_join(F.array_sort(scores.file_paths(text)), ",").alias("files"), F.array_join(F.array_sort(scores.function_names(text)), ",").alias("functions"))


@query("SELECT json_extract_string(props, '$.' || json_keys(props)[1]) AS value, json_keys(props)[1] AS key, count(*) AS n FROM events GROUP BY 1, 2")
def scalar_json_column(spark, d):
    e = t.table(spark, d, "events", "props").select(F.from_json("props", "map<string,string>").alias("m"))
    key = F.get(F.map_keys("m"), F.lit(0))
    return e.select(key.alias("key"), F.element_at("m", key).alias("value")).groupBy("key", "value").agg(F.count("*").alias("n"))


@query("SELECT doc_id, concat_ws(' ', nullif(source, 'src1'), lang, nullif(left(text, 20), '')) AS body, array_to_string(list_filter([CASE WHEN lang = 'en' THEN 'language' END, CASE WHEN length(text) > 2000 THEN 'long' END], lambda v: v IS NOT NULL), '; ') AS reasons FROM documents")
def scalar_assembled_text(spark, d):
    docs = t.table(spark, d, "documents", "doc_id", "text", "lang", "source")
    reasons = F.array_compact(F.array(F.when(F.col("lang") == "en", "language"), F.when(F.length("text") > 2000, "long")))
    return docs.select("doc_id", F.concat_ws(" ", F.nullif("source", F.lit("src1")), "lang", F.nullif(F.left("text", F.lit(20)), F.lit(""))).alias("body"), F.array_join(reasons, "; ").alias("reasons"))


@query("""WITH w AS (SELECT p_partkey AS k, list_distinct(regexp_extract_all(p_name || ' ' || p_type, '[A-Za-z0-9_:]+')) AS w FROM part), u AS (SELECT k, unnest(w) AS t FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(t) DESC, t) AS n FROM u) SELECT k, string_agg(t, ',' ORDER BY n) AS longest FROM r WHERE n <= 3 GROUP BY 1""")
def scalar_longest_tokens(spark, d):
    p = t.table(spark, d, "part", "p_partkey", "p_name", "p_type")
    return p.select(F.col("p_partkey").alias("k"), F.array_join(fn.longest_tokens(F.concat_ws(" ", "p_name", "p_type"), 3), ",").alias("longest"))
