"""Drift of many series with state: a sequential test of each key's share of bad events.

Events are counted by key and day before anything is keyed to state, so that a busy key sends one row a day
to its task. A day is final when the watermark passes its end; then its counts move the key's score, by
the log-likelihood ratio of raised against usual odds, never below zero. Above a limit the key has an alarm
and starts anew. A timer reports a key that has gone silent. Scores are whole millionths, so the result does
not depend on the batches in which days come, nor on a restart: each batch writes a folder by its number,
which a repeated batch overwrites.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from credence.session import ship_code

UNIT = 1_000_000
DAY = 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def usual_share(events: DataFrame, bad: Column, days: int = 7) -> float:
    """The share of bad events in the first days of a table, one number; zero where there are none."""
    start = events.agg(F.date_trunc("day", F.min("ts")).alias("start"))
    early = events.join(F.broadcast(start)).where(F.col("ts") < F.col("start") + F.expr(f"INTERVAL {days} DAYS"))  # the start is one row
    return early.agg(F.avg(bad.cast("int"))).first()[0] or 0.0


def steps(usual: float, odds: float) -> tuple[int, int]:
    """What a bad and a good event add to the score, in millionths: log-likelihood ratios of odds raised by
    a factor against the usual share."""
    fall = -math.log(1 + (odds - 1) * usual)
    return round(UNIT * (math.log(odds) + fall)), round(UNIT * fall)


def daily(events: DataFrame, key: str, bad: Column) -> DataFrame:
    """``(key, ends, n, bad)`` by key and day; ``ends`` is the day's end in milliseconds."""
    days = events.groupBy(key, F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return days.select(key, F.unix_millis(F.col("w.end")).alias("ends"), "n", "bad")


class Cusum(StatefulProcessor):
    """State of a key: its score, the end of its last day, whether it has been reported silent."""

    SCHEMA = "named string, since long, n long, bad long, score long, state string"
    COLUMNS = ["named", "since", "n", "bad", "score", "state"]

    def __init__(self, step: tuple[int, int], limit: int, quiet: int):
        self.step, self.limit, self.quiet = step, limit, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cusum", "score long, ends long, silent boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        score, last, silent = self.state.get() if self.state.exists() else (0, None, False)
        if last is not None and not silent:
            self.handle.deleteTimer(last + self.quiet)
        out = []
        for ends, n, bad in sorted((int(r.ends), int(r.n), int(r.bad)) for pdf in rows for r in pdf.itertuples()):
            if last is not None and not silent and ends - DAY - last >= self.quiet:
                out.append((key[0], last, 0, 0, score, "silent"))
            score = max(0, score + bad * self.step[0] + (n - bad) * self.step[1])
            alarm = score > self.limit
            out.append((key[0], ends - DAY, n, bad, score, "alarm" if alarm else "steady"))
            score, last, silent = 0 if alarm else score, ends, False
        self.state.update((score, last, silent))
        self.handle.registerTimer(last + self.quiet)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        score, last, _ = self.state.get()
        self.state.update((score, last, True))
        yield pd.DataFrame([(key[0], last, 0, 0, score, "silent")], columns=self.COLUMNS)

    def close(self) -> None:
        pass


def cusum(events: DataFrame, key: str, bad: Column, usual: float, odds: float = 2.0, limit: float = 3.0, quiet_days: int = 3) -> DataFrame:
    """``(key, day, n, bad, score, state)`` of a stream of events with a watermark on ``ts``.

    A row for each key and day with events, ``steady`` or ``alarm``, and one ``silent`` row for the first day
    of each gap of ``quiet_days`` or more, as soon as the watermark has passed them. Events later than the
    watermark and those without a time are left out; a null key is a series of its own.
    """
    days = daily(events, key, bad)
    ship_code(events.sparkSession)
    named = F.to_json(F.struct(key)).alias("named")  # rows of a null key would not be taken together
    step = Cusum(steps(usual, odds), round(limit * UNIT), quiet_days * DAY)
    out = days.select(named, "ends", "n", "bad").groupBy("named").transformWithStateInPandas(step, Cusum.SCHEMA, "Append", "EventTime")
    back = F.from_json("named", T.StructType([days.schema[key]]))[key].alias(key)
    return out.select(back, F.timestamp_millis("since").alias("day"), "n", "bad", (F.col("score") / UNIT).alias("score"), "state")


def resumed(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is new since the folder's checkpoint; all results so far as a table."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # keyed state with timers needs this store
    try:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch=*")
