"""A streaming view of events: windows, running rates, drift, repeats under a watermark.

Our addition; the batch forms of the same aggregations serve as its check. Results go to Parquet in
the folder that executors share, never through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.session import shared_folder

LATENESS = "1 day"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Files of events as a stream; the time column is made a UTC timestamp."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        stream, path = stream.option("pathGlobFilter", where.getName()), where.getParent().toString()
    raw = stream.parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)


def event_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: Column) -> DataFrame:
    """Counts and outcome rate of each window and event type (an error is a bad outcome)."""
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean_value"
    )


def tumbling(events: DataFrame) -> DataFrame:
    return windowed(events, F.window("ts", "1 day"))


def sliding(events: DataFrame) -> DataFrame:
    return windowed(events, F.window("ts", "2 days", "1 day"))


def sessions(events: DataFrame) -> DataFrame:
    """Sessions of a user: events no more than an hour apart."""
    return events.groupBy(F.session_window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n", "total"
    )


def running_rate(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def drift(events: DataFrame, usual: float = 0.2, limit: float = 0.02) -> DataFrame:
    """Days whose share of errors is off the usual share by more than a limit."""
    d = events.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "error").cast("int")).alias("rate"))
    return d.select(F.col("w.start").alias("day"), "n", F.round("rate", 6).alias("rate"), (F.abs(F.col("rate") - usual) > limit).alias("alarm"))


def first_of_each(events: DataFrame) -> DataFrame:
    """Repeats of an event id within the watermark are dropped."""
    kept = events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return kept.select("event_id", "event_type")


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there now and return its last result as a table.

    Each batch has a folder of its own, by its number, which a repeated batch overwrites; in complete
    mode the last one is the result, else all of them are.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    last = []

    def keep(batch: DataFrame, number: int) -> None:
        last[:] = [number]
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    out = f"{folder}/out/batch={last[0] if mode == 'complete' else '*'}"
    return spark.read.schema(stream.schema).parquet(out) if last else spark.createDataFrame([], stream.schema)


def streamed(spark: SparkSession, path: str, view: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    return run_to_table(view(event_stream(spark, path)), mode)
