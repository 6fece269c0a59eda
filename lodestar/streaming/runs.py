"""Event streams over several runs: late rows beside sessions, records seen in earlier runs, and runs that end or time out.

A run reads what has come into a folder since the last one (`availableNow`) and keeps its state under `at`, in the folder that
all executors share; tables it writes have a folder for each batch, which a repeated batch overwrites.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def run(rows: DataFrame, at: str, mode: str = "append") -> None:
    """Runs a stream to the end of what is there and adds its rows to the table at/out."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    q = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def written(spark: SparkSession, schema, at: str) -> DataFrame:
    """What runs have written to at/out."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{at}/out")


# late rows and sessions


def split_late(rows: DataFrame, at: str, delay: str, time: str = "ts") -> None:
    """Runs rows into two tables: at/ontime, and at/late for rows older than the mark: the latest time of all earlier batches
    less the delay. That is what a watermark would drop, kept instead."""
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        before = None if number == 0 else spark.read.schema("batch long, mark timestamp").parquet(f"{at}/marks").where(F.col("batch") < number)
        mark = None if before is None else before.agg(F.max("mark")).first()[0]
        late = F.lit(False) if mark is None else F.col(time) < F.lit(mark) - F.expr(f"INTERVAL {delay}")
        batch.where(~late).write.mode("overwrite").parquet(f"{at}/ontime/batch={number}")
        batch.where(late).write.mode("overwrite").parquet(f"{at}/late/batch={number}")
        batch.agg(F.lit(number).cast("long").alias("batch"), F.max(time).cast("timestamp").alias("mark")).write.mode("overwrite").parquet(f"{at}/marks/n={number}")

    q = rows.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def tables(spark: SparkSession, schema, path: str, streaming: bool = False) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema(schema).option("pathGlobFilter", "*.parquet")
    return reader.parquet(f"{path}/batch=*") if streaming else reader.option("recursiveFileLookup", True).parquet(path)


def sessions(rows: DataFrame, key: str, gap: str, delay: str, time: str = "ts") -> DataFrame:
    """(key, start, end, events) of sessions without a pause of `gap`; a stream gives each once, when the watermark has passed it."""
    timed = rows.withWatermark(time, delay) if rows.isStreaming else rows
    return timed.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


# records that earlier runs have seen


def record_hash(rows: DataFrame) -> Column:
    """The SHA-256 of a whole record, whatever its columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256)


def unseen(rows: DataFrame, epoch: int = 0) -> DataFrame:
    """Records that no earlier row or run over the same state was equal to, with their hash.

    The state holds a hash and an epoch for each record and stays in the JVM. What a run has committed is seen by the next; a
    higher epoch starts over: every record is new again once, without the state being deleted.
    """
    hashed = rows.select("*", record_hash(rows).alias("record_hash"), F.lit(epoch).alias("epoch"))
    return hashed.dropDuplicates(["record_hash", "epoch"])


# runs of an analyzer, from the events of which they consist

RUN_OUT = "user_id long, run long, started long, ended long, successful long, failed long, cached long, how string"
_STATE = "run long, started long, last long, successful long, failed long, cached long"
_COLUMNS = [c.split()[0] for c in RUN_OUT.split(", ")]
_COUNTS = {"success": 3, "failure": 4, "cached": 5}


def followed(events: DataFrame, delay: str, patience_ms: int) -> DataFrame:
    """RUN_OUT (times in microseconds) of the runs in events(user_id, event_id, ts, kind): `start` begins a run, `success`,
    `failure` and `cached` count, `end` ends it; a start inside a run ends that one (`restarted`), and a pause of more than
    patience_ms does (`timed out`), by a timer if no event follows. Events outside a run do not count. A user's events are taken in
    the order of their times within a batch. The state is one row a user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now = list(state.get) if state.exists else [0, -1, -1, 0, 0, 0]  # -1: no run is open

        def close(at: int, how: str) -> None:
            out.append((key[0], now[0], now[1], at, *now[3:], how))
            now[1:] = [-1, -1, 0, 0, 0]

        if state.hasTimedOut:
            if now[1] >= 0:
                close(now[2], "timed out")
        else:
            held = list(batches)  # a frame's own sort costs more than the events of most users
            us, ids, kinds = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("us", "event_id", "kind"))
            order = np.lexsort((ids, us))
            for at, kind in zip(us[order].tolist(), kinds[order].tolist(), strict=True):
                if now[1] >= 0 and at - now[2] > patience_ms * 1000:
                    close(now[2], "timed out")
                if kind == "start":
                    if now[1] >= 0:
                        close(at, "restarted")
                    now[:3] = [now[0] + 1, at, at]
                elif now[1] >= 0:
                    now[2] = at
                    if kind == "end":
                        close(at, "ended")
                    else:
                        now[_COUNTS[kind]] += 1
        state.update(tuple(now))
        if now[1] >= 0:
            state.setTimeoutTimestamp(max(now[2] // 1000 + patience_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    timed = events.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    return timed.groupBy("user_id").applyInPandasWithState(step, RUN_OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
