"""Queries on streams that take several runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans import scratch
from ..plans import stand_ins as t
from ..registry import query
from ..streaming import runs

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, arrived int"
ARRIVED = "CASE WHEN event_id % 13 = 5 THEN 3 WHEN dayofmonth({ts}) <= 8 THEN 0 WHEN dayofmonth({ts}) <= 15 THEN 1 WHEN dayofmonth({ts}) <= 22 THEN 2 ELSE 3 END"


def _events(spark, d):
    e = t.table(spark, d, "events", "event_id", "ts", "user_id", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("arrived", F.expr(ARRIVED.format(ts="ts")))


def _folder(spark, name):
    scratch.checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


LATE_SQL = f"""e AS (SELECT event_id, ts, user_id, {ARRIVED.format(ts='ts')} AS arrived FROM events),
m AS (SELECT a.arrived, max(b.ts) AS mark FROM (SELECT DISTINCT arrived FROM e) a LEFT JOIN e b ON b.arrived < a.arrived GROUP BY 1),
j AS (SELECT e.*, mark IS NOT NULL AND ts < mark - INTERVAL 2 DAY AS late FROM e JOIN m USING (arrived)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM j WHERE NOT late)),
s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS z, count(*) AS n FROM g GROUP BY user_id, s)"""


@query(f"""WITH {LATE_SQL} SELECT 'session' AS kind, user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, n FROM s WHERE z < (SELECT max(ts) FROM e WHERE true) - INTERVAL 2 DAY
UNION ALL SELECT 'late', user_id, NULL, count(*) FROM j WHERE late GROUP BY user_id""")
def stream_sessions(spark, d):
    """Four runs over one checkpoint: sessions with six idle hours between them, closed by a watermark of two days; rows that
    come later than that are counted beside them."""
    at, events = _folder(spark, "sessions"), _events(spark, d)
    for k in range(4):
        events.where(F.col("arrived") == k).write.parquet(f"{at}/in/batch={k}")
        runs.split_late(runs.tables(spark, EVENTS, f"{at}/in", streaming=True), at, "2 days")
        closed = runs.sessions(runs.tables(spark, EVENTS, f"{at}/ontime", streaming=True), "user_id", "6 hours", "2 days")
        runs.run(closed, f"{at}/closed")
    done = runs.written(spark, "user_id long, start timestamp, end timestamp, events long", f"{at}/closed")
    late = runs.tables(spark, EVENTS, f"{at}/late").groupBy("user_id").agg(F.count("*").alias("n"))
    one = done.select(F.lit("session").alias("kind"), "user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.col("events").alias("n"))
    return one.unionByName(late.select(F.lit("late").alias("kind"), "user_id", F.lit(None).cast("string").alias("start"), "n"))


@query(f"""WITH e AS (SELECT user_id, event_type, date_trunc('day', ts) AS day, {ARRIVED.format(ts='ts')} AS arrived FROM events),
f AS (SELECT user_id, event_type, day, min(arrived) AS arrived FROM e GROUP BY 1, 2, 3), n AS (SELECT count(*) AS n FROM f)
SELECT arrived::INT AS run, count(*) AS new FROM f GROUP BY 1 UNION ALL SELECT 4, n FROM n""")
def stream_unseen_records(spark, d):
    """Four runs over one checkpoint each give only records that none before them had; after a reset all are new again."""
    at = _folder(spark, "unseen")
    schema = "user_id long, event_type string, day timestamp"
    records = _events(spark, d).select("user_id", "event_type", F.date_trunc("day", "ts").alias("day"), "arrived")

    def more(run: int, epoch: int) -> None:
        rows = runs.unseen(runs.tables(spark, schema, f"{at}/in", streaming=True), epoch)
        runs.run(rows.withColumn("run", F.lit(run)), f"{at}/seen")

    for k in range(4):
        records.where(F.col("arrived") == k).drop("arrived").write.parquet(f"{at}/in/batch={k}")
        more(k, 0)
    records.drop("arrived").write.parquet(f"{at}/in/batch=9")  # nothing of it is new until the registry starts over
    more(3, 0)
    records.drop("arrived").write.parquet(f"{at}/in/batch=10")
    more(4, 1)
    out = runs.written(spark, f"{schema}, record_hash string, epoch int, run int", f"{at}/seen")
    return out.groupBy("run").agg(F.count("*").alias("new"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'view' THEN 'cached' ELSE 'end' END AS kind FROM events),
r AS (SELECT *, count(*) FILTER (WHERE kind = 'start') OVER w AS run, ts - lag(ts) OVER w > INTERVAL 1 DAY AS pause FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT *, min(ts) FILTER (WHERE kind = 'end' OR pause AND kind <> 'start') OVER (PARTITION BY user_id, run) AS stop FROM r WHERE run > 0),
y AS (SELECT *, kind = 'end' AND NOT coalesce(pause, false) AND ts = stop AS ends, ts < stop OR stop IS NULL OR ts = stop AND kind = 'end' AND NOT coalesce(pause, false) AS inside FROM x),
z AS (SELECT user_id, run, min(ts) AS a, max(ts) AS last, bool_or(ends) AS ended, count(*) FILTER (WHERE kind = 'success') AS successful, count(*) FILTER (WHERE kind = 'failure') AS failed, count(*) FILTER (WHERE kind = 'cached') AS cached, max(stop) AS stop FROM y WHERE inside GROUP BY 1, 2),
n AS (SELECT z.*, lead(a) OVER (PARTITION BY user_id ORDER BY run) AS next, (SELECT max(ts) FROM e) - INTERVAL 1 HOUR AS mark FROM z)
SELECT user_id, run, successful, failed, cached, CASE WHEN ended THEN 'ended' WHEN stop IS NOT NULL OR next - last > INTERVAL 1 DAY OR next IS NULL AND last + INTERVAL 1 DAY < mark THEN 'timed out' ELSE 'restarted' END AS how
FROM n WHERE ended OR stop IS NOT NULL OR next IS NOT NULL OR last + INTERVAL 1 DAY < mark""")
def stream_followed_runs(spark, d):
    """Runs of an analyzer from their events, in three runs of the stream; a run without an end is ended by a timer."""
    at = _folder(spark, "followed")
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'view' THEN 'cached' ELSE 'end' END")
    events = t.table(spark, d, "events", "event_id", "ts", "user_id", "event_type").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", kind.alias("kind"))
    part = F.when(F.dayofmonth("ts") <= 10, 0).when(F.dayofmonth("ts") <= 20, 1).otherwise(2)
    for k in range(3):
        events.where(part == k).write.parquet(f"{at}/in/batch={k}")
        rows = runs.tables(spark, "event_id long, ts timestamp, user_id long, kind string", f"{at}/in", streaming=True)
        runs.run(runs.followed(rows, "1 hour", 86_400_000), f"{at}/ended")
    out = runs.written(spark, runs.RUN_OUT, f"{at}/ended")
    return out.select("user_id", "run", "successful", "failed", "cached", "how")
