"""Queries on stores, accounts, sessions and registries: customers are repositories, orders analyses, events usage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import knowledge
from ..plans import scratch
from ..plans import stand_ins as t
from ..registry import query

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END"


def _status():
    return F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")


@query("SELECT o_orderkey, c_name, o_totalprice, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def account_analysis_view(spark, d):
    o, c, n = t.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice"), t.table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'"), t.table(spark, d, "nation", "n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "o_totalprice", "n_name")


@query("WITH j AS (SELECT o_orderkey, o_orderdate, count(*) OVER () AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 AND o_orderstatus = 'F') SELECT o_orderkey, total FROM j ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 5")
def account_page_with_total(spark, d):
    o, c = t.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").where("o_orderstatus = 'F'"), t.table(spark, d, "customer", "c_custkey", "c_nationkey").where("c_nationkey = 7")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    page = j.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(5).limit(10).select("o_orderkey")
    return page.crossJoin(F.broadcast(j.agg(F.count("*").alias("total"))))


@query("SELECT c_nationkey, o_orderkey FROM (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey) AS k FROM customer JOIN orders ON c_custkey = o_custkey) WHERE k = 1")
def account_newest_installation(spark, d):
    o, c = t.table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), t.table(spark, d, "customer", "c_custkey", "c_nationkey")
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey")).withColumn("at", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc_nulls_last("at"), "o_orderkey"))
    return j.withColumn("k", k).where("k = 1").select("c_nationkey", "o_orderkey")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY 1, 2 HAVING count(*) > 1")
def account_migration_check(spark, d):
    c, o = t.table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment"), t.table(spark, d, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'P'")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).where("n > 1")


CENTS = "round(value * 100)::BIGINT"


@query(f"SELECT user_id, event_type, sum({CENTS})::BIGINT AS cents, count(*) AS n, min(strftime(ts, '%Y-%m-%d')) AS first, grouping(user_id, event_type)::BIGINT AS g FROM events GROUP BY GROUPING SETS ((user_id), (event_type), (user_id, event_type), ())")
def usage_by_user_and_kind(spark, d):
    e = t.table(spark, d, "events", "user_id", "event_type", "value", "ts").withColumn("cents", F.round(F.col("value") * 100).cast("long")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    sets = [[F.col("user_id")], [F.col("event_type")], [F.col("user_id"), F.col("event_type")], []]
    return e.groupingSets(sets, "user_id", "event_type").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"), F.min("day").alias("first"), F.grouping_id().alias("g"))


@query(f"SELECT event_id, sum({CENTS}) OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM events")
def usage_running_totals(spark, d):
    e = t.table(spark, d, "events", "event_id", "user_id", "event_type", "ts", "value")
    w = Window.partitionBy("user_id", F.col("event_type") == "click").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("running"))


@query(f"WITH p AS (SELECT * FROM (VALUES ('click', 3), ('view', 1), (NULL, 7)) v(kind, price)) SELECT event_type, sum({CENTS} * coalesce(p.price, (SELECT price FROM p WHERE kind IS NULL)))::BIGINT AS cost FROM events LEFT JOIN p ON p.kind = event_type GROUP BY 1")
def usage_cost(spark, d):
    """Usage by a table of prices, the row without a kind for all others."""
    prices = spark.createDataFrame([("click", 3), ("view", 1)], "event_type string, price long")
    e = t.table(spark, d, "events", "event_type", "value").join(F.broadcast(prices), "event_type", "left")
    return e.groupBy("event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long") * F.coalesce("price", F.lit(7))).alias("cost"))


@query("WITH s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events), u AS (SELECT user_id, day, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS usage, count(*) FILTER (WHERE event_type = 'error') AS failed FROM s GROUP BY 1, 2) SELECT count(*) AS sessions, sum(usage)::BIGINT AS usage, sum(failed)::BIGINT AS failed, sum(usage * failed)::BIGINT AS fanned_out, min(day) AS first FROM u")
def usage_session_aggregate(spark, d):
    """All sessions, and what two joins before the sum would have counted."""
    e = t.table(spark, d, "events", "user_id", "event_type", "ts").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    u = e.groupBy("user_id", "day").agg(F.count_if(F.col("event_type").isin("click", "view")).alias("usage"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return u.agg(F.count("*").alias("sessions"), F.sum("usage").alias("usage"), F.sum("failed").alias("failed"), F.sum(F.col("usage") * F.col("failed")).alias("fanned_out"), F.min("day").alias("first"))


@query("SELECT event_id, count(*) OVER w - 1 AS ahead, count(*) OVER w - 1 < 3 AS admitted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)")
def usage_admission(spark, d):
    """Three calls a day for each user."""
    return knowledge.admitted(t.table(spark, d, "events", "event_id", "user_id", "ts"), ["user_id"], "ts", 3, 86_400).select("event_id", "ahead", "admitted")


@query("SELECT user_id, event_type, max_by(event_id, event_id) AS event_id, min(event_id) AS created_at, max(event_id) AS updated_at FROM (SELECT user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type, event_id FROM events) GROUP BY 1, 2")
def knowledge_upsert(spark, d):
    e = t.table(spark, d, "events", "user_id", "event_type", "event_id").withColumn("event_type", F.when(F.col("event_id") % 7 != 0, F.col("event_type"))).withColumn("updated_at", F.col("event_id"))
    return knowledge.learned(e.where("event_id % 3 > 0"), e.where("event_id % 3 = 0"), ["user_id", "event_type"])


@query("SELECT event_id, value FROM events WHERE user_id = 3 AND event_type = 'click' ORDER BY ts DESC, event_id LIMIT 5")
def knowledge_recall(spark, d):
    return knowledge.recalled(t.table(spark, d, "events"), [F.desc("ts"), "event_id"], 5, user_id=3, event_type="click", props=None).select("event_id", "value")


@query("""WITH s AS (SELECT 'fn' || (event_id % 9) AS name, 'c' || (event_id % 4) AS checksum, event_id FROM events), f AS (SELECT DISTINCT 'fn' || (s_suppkey % 12) AS name, 'c' || (s_suppkey % 12 % 3) AS now FROM supplier),
r AS (SELECT name, event_id, checksum = now AS fresh, row_number() OVER (PARTITION BY name ORDER BY checksum = now DESC, event_id) AS k FROM f JOIN s USING (name)) SELECT name, event_id, fresh FROM r WHERE k <= 3 ORDER BY name, k LIMIT 12""")
def knowledge_prior(spark, d):
    e, s = F.col("event_id"), F.col("s_suppkey")
    store = t.table(spark, d, "events", "event_id").select(F.concat(F.lit("fn"), (e % 9).cast("string")).alias("name"), F.concat(F.lit("c"), (e % 4).cast("string")).alias("checksum"), "event_id")
    functions = t.table(spark, d, "supplier", "s_suppkey").select(F.concat(F.lit("fn"), (s % 12).cast("string")).alias("name"), F.concat(F.lit("c"), (s % 12 % 3).cast("string")).alias("checksum")).distinct()
    return knowledge.prior(functions, store, ["event_id"], 3, 12).select("name", "event_id", "fresh")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'completed' WHEN o_orderkey % 5 = 1 THEN 'running' ELSE {STATUS} END AS status, o_orderkey % 5 = 1 AND o_orderkey % 2 = 0 AS started, o_orderkey % 5 = 0 OR o_orderstatus <> 'P' AS ended, o_orderkey % 5 IN (0, 1) AND o_orderkey % 4 = 0 AS renamed FROM orders")
def store_updates(spark, d):
    """Status changes that set dates, and updates of only some columns."""
    k = F.col("o_orderkey")
    now = F.lit("2003-01-01").cast("timestamp_ntz")
    rows = t.table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").select(k, _status().alias("status"), F.when(k % 2 == 1, F.col("o_orderdate")).alias("started_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("completed_at"), F.lit("old").alias("name"))
    changed = rows.where(k % 5 < 2).select("o_orderkey", F.when(k % 5 == 0, "completed").otherwise("running").alias("status"))
    after = knowledge.with_status(rows, changed, "o_orderkey", now)
    after = knowledge.updated(after, rows.where(k % 5 < 2).select("o_orderkey", F.when(k % 4 == 0, "new").alias("name")), "o_orderkey")
    return after.select("o_orderkey", "status", ((F.col("started_at") == now) & (k % 2 == 0)).alias("s"), F.col("completed_at").isNotNull().alias("ended"), (F.col("name") == "new").alias("renamed")).withColumn("started", F.coalesce("s", F.lit(False))).drop("s")


@query(f"WITH a AS (SELECT o_orderkey, {STATUS} = 'completed' AND o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 90 DAY AS gone FROM orders) SELECT count(*) FILTER (WHERE gone) AS deleted, count(*) FILTER (WHERE NOT gone) AS kept, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM a WHERE NOT gone)) AS children FROM a")
def store_retention_cascade(spark, d):
    """Completed analyses of over ninety days go, and their results with them."""
    o = t.table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").select("o_orderkey", _status().alias("status"), F.col("o_orderdate").alias("completed_at"))
    o = o.withColumn("gone", knowledge.expired(o, F.lit("2001-01-01").cast("timestamp_ntz")))
    left = knowledge.children_of(t.table(spark, d, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey"), o.where("NOT gone"), "o_orderkey")
    return o.agg(F.count_if(F.col("gone")).alias("deleted"), F.count_if(~F.col("gone")).alias("kept")).crossJoin(F.broadcast(left.agg(F.count("*").alias("children"))))


@query("SELECT p_partkey, (contains(lower(p_name), 're')::INT + contains(lower(p_type), 'medium')::INT + contains(lower(p_name), 'blue')::INT) / 3.0::DOUBLE AS score FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_type), 'medium') OR contains(lower(p_name), 'blue') ORDER BY 2 DESC, 1 LIMIT 20")
def catalog_keywords(spark, d):
    p = t.table(spark, d, "part", "p_partkey", "p_name", "p_type").withColumn("id", F.col("p_partkey"))
    # each word is looked for in the field where the catalogue has it
    body = F.concat_ws(" ", F.regexp_replace(F.lower("p_name"), "medium", ""), F.when(F.contains(F.lower("p_type"), F.lit("medium")), "medium"))
    return knowledge.catalog_search(p, ["re", "MEDIUM", "blue"], body, 20).select("p_partkey", "score")


@query("SELECT 'CWE-' || (p_partkey % 10) AS id, count(*) AS n, count(*) FILTER (WHERE contains(lower(p_type), 'medium')) AS medium FROM part GROUP BY 1")
def catalog_categories(spark, d):
    k = (F.col("p_partkey") % 10).cast("string")
    given = F.when(F.col("p_partkey") % 2 == 0, k).otherwise(F.concat(F.lit(" cwe-"), k))
    return t.table(spark, d, "part", "p_partkey", "p_type").groupBy(knowledge.catalog_id(given).alias("id")).agg(F.count("*").alias("n"), F.count_if(F.contains(F.lower("p_type"), F.lit("medium"))).alias("medium"))


WORDS = r"list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: w)"


@query(f"""WITH f AS (SELECT p_partkey, 'p_name' AS field, {WORDS.format('p_name')} AS w FROM part UNION ALL SELECT p_partkey, 'p_type', {WORDS.format('p_type')} FROM part),
h AS (SELECT p_partkey, field, len(list_filter(range(1, len(w)), lambda i: w[i] = 'red' AND w[i + 1] = 'widget')) AS a, len(list_filter(w, lambda x: x = 'promo')) AS b FROM f)
SELECT p_partkey, field, 'red widget' AS phrase, a AS n FROM h WHERE a > 0 UNION ALL SELECT p_partkey, field, 'PROMO' AS phrase, b FROM h WHERE b > 0""")
def search_phrases(spark, d):
    """Phrases of a free query, words next to each other, in two fields."""
    found = fn.phrases("red::widget a PROMO (x)")
    return knowledge.phrase_hits(t.table(spark, d, "part", "p_partkey", "p_name", "p_type"), "p_partkey", ["p_name", "p_type"], found)


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 2 = 0)")
def store_unseen_records(spark, d):
    e = t.table(spark, d, "events", "event_id", "user_id", "event_type")
    cols = ["user_id", "event_type"]
    registry = e.where("event_id % 2 = 0").select(F.sha2(F.to_json(F.struct(*cols)), 256).alias("hash")).distinct()
    return knowledge.unseen(e.select(*cols).distinct(), registry, cols).agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 > 0), n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents) SELECT n.doc_id, CASE WHEN o.h IS NULL THEN 'insert' WHEN o.h = n.h THEN 'skip' ELSE 'update' END AS action FROM n LEFT JOIN o USING (doc_id)")
def store_vector_upsert(spark, d):
    """Texts are embedded again only where their hash has changed."""
    docs = t.table(spark, d, "documents", "doc_id", "text")
    old = docs.where("doc_id % 3 > 0").select("doc_id", F.md5("text").alias("h"))
    new = docs.select("doc_id", F.md5(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("now"))
    return new.join(old, "doc_id", "left").select("doc_id", F.when(F.col("h").isNull(), "insert").when(F.col("h") == F.col("now"), "skip").otherwise("update").alias("action"))


@query("SELECT 'fn' || (l_partkey % 90) AS name, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS places FROM lineitem GROUP BY 1")
def registry_merge(spark, d):
    """Registries of several runs as one, places of a name without repeats."""
    item = t.table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_returnflag")
    one = lambda f: item.where(F.col("l_returnflag") == f).groupBy(F.concat(F.lit("fn"), (F.col("l_partkey") % 90).cast("string")).alias("name")).agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("places"))
    return knowledge.merged(one("A"), one("N"), one("R")).withColumn("places", F.array_join("places", ","))


@query("SELECT name, kind, row_number() OVER (ORDER BY name, kind, k) AS place FROM (SELECT p_brand AS name, 'p' AS kind, p_partkey AS k FROM part UNION ALL SELECT s_name, 's', s_suppkey FROM supplier)")
def registry_union(spark, d):
    """Symbols of two languages in one sorted list, repeats kept."""
    p = t.table(spark, d, "part", "p_partkey", "p_brand").select(F.col("p_brand").alias("name"), F.lit("p").alias("kind"), F.col("p_partkey").alias("k"))
    s = t.table(spark, d, "supplier", "s_suppkey", "s_name").select(F.col("s_name").alias("name"), F.lit("s").alias("kind"), F.col("s_suppkey").alias("k"))
    return scratch.ranked(p.unionByName(s), ["name", "kind", "k"], "place").select("name", "kind", (F.col("place") + 1).alias("place"))


@query("WITH x AS (SELECT l_shipdate, l_returnflag AS f, l_quantity::BIGINT AS q FROM lineitem), m AS (SELECT year(l_shipdate) AS y, sum(q) FILTER (WHERE f = 'A') AS a, sum(q) FILTER (WHERE f = 'N') AS n, sum(q) FILTER (WHERE f = 'R') AS r FROM x GROUP BY 1) SELECT y, (n - a)::BIGINT AS with_without, (r - a)::BIGINT AS ambivalent_without, (r - n)::BIGINT AS ambivalent_with FROM m")
def registry_three_way_deltas(spark, d):
    x = t.table(spark, d, "lineitem", "l_shipdate", "l_returnflag", "l_quantity")
    m = x.groupBy(F.year("l_shipdate").alias("y")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum(F.col("l_quantity").cast("long")))
    return m.select("y", (F.col("N") - F.col("A")).alias("with_without"), (F.col("R") - F.col("A")).alias("ambivalent_without"), (F.col("R") - F.col("N")).alias("ambivalent_with"))


@query("WITH e AS (SELECT 'a' || (l_partkey % 4) || '/b' || (l_partkey % 6) AS src, 'a' || (l_suppkey % 5) || '/b' || (l_suppkey % 7) || '/c' AS dst FROM lineitem WHERE l_quantity > 48), m AS (SELECT DISTINCT string_split(src, '/')[1] AS src, string_split(dst, '/')[1] AS dst FROM e) SELECT src, string_agg(dst, ',' ORDER BY dst) AS needs FROM m WHERE src <> dst GROUP BY 1")
def registry_directory_dependencies(spark, d):
    """Dependencies of files merged to their first folder, those inside one folder left out."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    part = lambda *v: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in v])
    e = t.table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity").where("l_quantity > 48").select(part("a", p % 4, "/b", p % 6).alias("src"), part("a", s % 5, "/b", s % 7, "/c").alias("dst"))
    top = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, 1), "/")
    return e.select(top("src").alias("src"), top("dst").alias("dst")).where("src <> dst").groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("needs"))


@query("SELECT lang, sum(len(string_split(text, chr(10))))::BIGINT AS lines, count(*) AS files, count(*) > 10000 AS over_limit FROM documents GROUP BY 1")
def files_line_counts(spark, d):
    docs = t.table(spark, d, "documents", "lang", "text")
    return docs.groupBy("lang").agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.count("*").alias("files")).withColumn("over_limit", F.col("files") > 10_000)


@query("SELECT lower(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1]) AS name, min(url) AS nearest, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def files_by_name(spark, d):
    """An index of files by lower-cased base name, ambiguous names only, with the first by path."""
    p = t.table(spark, d, "pages", "url").withColumn("name", F.lower(fn.base_name(F.regexp_replace("url", "[?#].*$", ""))))
    return p.groupBy("name").agg(F.min("url").alias("nearest"), F.count("*").alias("n")).where("n > 1")


@query("WITH c AS (SELECT o_custkey AS branch, max(o_orderdate) AS last FROM orders GROUP BY 1), m AS (SELECT max(last) AS m FROM c) SELECT branch FROM c, m WHERE last >= m - INTERVAL 60 DAY")
def history_recent_branches(spark, d):
    c = t.table(spark, d, "orders", "o_custkey", "o_orderdate").groupBy(F.col("o_custkey").alias("branch")).agg(F.max("o_orderdate").alias("last"))
    m = F.broadcast(c.agg(F.max("last").alias("m")))
    return c.crossJoin(m).where(F.col("last") >= F.col("m") - F.expr("INTERVAL 60 DAY")).select("branch")


@query("WITH m AS (SELECT max(o_orderdate) AS m FROM orders), n AS (SELECT d, (SELECT count(DISTINCT o_custkey) FROM orders, m WHERE o_orderdate >= m - d * INTERVAL 1 DAY) AS n FROM (VALUES (1), (3), (33), (63), (93), (123), (153), (183), (213), (243), (273), (303), (333), (363), (365)) v(d)) SELECT d AS days, n AS files FROM n WHERE n >= 20 OR d = 365 ORDER BY d LIMIT 1")
def history_widening_window(spark, d):
    """The narrowest window of 1, 3 and then 30 days more, up to a year, in which 20 files changed: one scan counts all."""
    o = t.table(spark, d, "orders", "o_custkey", "o_orderdate")
    m = F.broadcast(o.agg(F.max("o_orderdate").alias("m")))
    days = [1, 3, *range(33, 365, 30), 365]
    last = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("l")).crossJoin(m)
    counts = last.agg(*[F.count_if(F.col("l") >= F.col("m") - F.expr(f"INTERVAL {n} DAY")).alias(str(n)) for n in days])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("days"), F.col(str(n)).alias("files")) for n in days])).alias("x")).select("x.*")
    return rows.where((F.col("files") >= 20) | (F.col("days") == 365)).orderBy("days").limit(1)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(round(value * 100)::BIGINT)::BIGINT AS cents, count(*) FILTER (WHERE event_type = 'purchase') AS successful, count(*) FILTER (WHERE event_type = 'error') AS failed FROM (SELECT DISTINCT * FROM events) GROUP BY 1")
def stream_run_counters(spark, d):
    """Counters of a stream that is read once to its end, each event counted once."""
    from ..streaming import events

    return events.counted_once(spark, f"{d}/events.parquet")


@query("SELECT date_trunc('hour', ts)::VARCHAR AS hour, count(*) AS events FROM events GROUP BY 1")
def stream_hourly_windows(spark, d):
    from ..streaming import events

    return events.hourly(spark, f"{d}/events.parquet")
