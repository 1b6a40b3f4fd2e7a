"""Readers and writers of result and log files, under fixed schemas and the write-once rule."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.operators.helpers import log_metadata

RESULTS = "record_id long, question_id string, split string, qtype string, kind string, position int, gold int, probs array<double>, labels array<string>, negated_p_yes double, cluster long"
LOG = "index long, record_id long, question_id string, labels array<string>, probs array<double>, action int, propensity double, outcome int, flipped int"


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines, gzip or not; a line that does not fit fails, a missing later field is null."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_lines(df: DataFrame, path: str, compress: bool = True) -> None:
    """JSON lines in a new folder; an existing one is refused."""
    df.write.mode("errorifexists").option("compression", "gzip" if compress else "none").option("ignoreNullFields", "false").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header under a fixed schema."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, RESULTS)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, LOG)


def write_by_split(df: DataFrame, path: str) -> None:
    """Parquet with a folder for each split, so that readers of one split skip the others."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def write_runs(df: DataFrame, path: str) -> None:
    """JSON lines with a folder for each run, named by column ``run``; an existing path is refused."""
    df.write.mode("errorifexists").option("compression", "gzip").option("ignoreNullFields", "false").partitionBy("run").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The results of all runs of a folder as one table; a filter on ``run`` skips the other folders."""
    return read_lines(spark, path, f"{RESULTS}, run string")


def write_log(log: DataFrame, path: str, name: str, sampling: dict | None, v3: dict | None = None) -> None:
    """A log as JSON lines under ``rows/log=<name>`` and how it was drawn, one JSON object, under
    ``metadata/log=<name>``; an older log without any has ``sampling`` None. Existing ones are refused."""
    write_lines(log, f"{path}/rows/log={name}")
    if sampling is not None:
        text = json.dumps({"sampling": sampling} | ({"v3": v3} if v3 else {}))
        log.sparkSession.createDataFrame([(text,)], "text string").coalesce(1).write.mode("errorifexists").text(f"{path}/metadata/log={name}")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """All logs of a folder as one table with the log's name as partition column."""
    return read_lines(spark, f"{path}/rows", f"{LOG}, log string")


def read_log_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(log, n, n_flipped, known, seed, flip_rate, noise)``: every log's metadata beside its counts. A log
    without metadata has nulls, since neither its seed nor its rate is known."""
    counts = read_logs(spark, path).groupBy("log").agg(F.count("*").alias("n"), F.count_if(F.col("flipped") != F.col("outcome")).alias("n_flipped"))
    texts = spark.read.schema("text string, log string").option("wholetext", True).text(f"{path}/metadata").select("log", "text", *log_metadata(F.col("text")))
    got = counts.join(texts, "log", "left")
    return got.select("log", "n", "n_flipped", F.col("text").isNotNull().alias("known"), "seed", "flip_rate", "noise")


def run_names(spark: SparkSession, path: str) -> DataFrame:
    """Runs in a folder of folders, with the parts of their names (learner, size, seed)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    run = F.element_at(F.split("path", "/"), -2)
    return files.select(run.alias("run")).distinct().select("run", F.regexp_extract("run", "^(.+)_n[0-9]+_s[0-9]+$", 1).alias("learner"),
                                                            F.regexp_extract("run", "_n([0-9]+)_s", 1).try_cast("int").alias("n"), F.regexp_extract("run", "_s([0-9]+)$", 1).try_cast("int").alias("seed"))
