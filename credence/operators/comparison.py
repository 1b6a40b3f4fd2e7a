"""Comparison of many runs against one base: what is there, whether it answers the same questions, and
contrasts of groups of runs with paired intervals.

A run is a row of a table with its parts (arm, size of training set, seed, noise); a contrast is a set of
terms, each naming a group of runs by those parts and a factor. All runs are read in one pass and keyed to
the base in one aggregation; runs that are absent or answer other questions become rows, and only the
contrasts that need them go without a value.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.functions import distributions as D
from credence.operators.helpers import parsed_run_name
from credence.operators.metrics import answers
from credence.operators.resampling import interval, slot_sums

KEY = ["split", "record_id", "question_id"]
METRICS = ["accuracy", "ece", "brier", "nll"]
TERMS = "contrast string, term int, arm string, n int, seed int, noise string, factor double"


def with_temperatures(runs: DataFrame, temperatures: DataFrame) -> DataFrame:
    """The runs and, for each row ``(run, of, t)``, the run ``of`` at temperature t under the name ``run``.
    The temperatures are one row a run, as those of a fit."""
    scaled = runs.withColumnRenamed("run", "of").join(F.broadcast(temperatures), "of").withColumn("probs", D.tempered(F.col("probs"), F.col("t")))
    return runs.unionByName(scaled.select(*runs.columns))


def run_alignment(runs: DataFrame, base: str, expected: Iterable[str]) -> DataFrame:
    """For each run and each split of the base, how the run's keys differ from the base's, and a status.

    Rows are first counted by key and run, so a key's list has one entry a run however often it repeats.
    ``missing``: the run has no rows; ``no split``: none in this split; ``misaligned``: keys of the base are
    absent, others are there, some repeat or have another gold answer; else ``aligned``. Runs that are
    expected or found are listed; nulls in a key are equal to each other. Splits without the base are left out.
    """
    wanted = F.array(*[F.lit(e) for e in expected]).cast("array<string>")
    names = runs.groupBy().agg(F.array_sort(F.array_union(F.collect_set("run"), wanted)).alias("names"), wanted.alias("wanted"))
    once = runs.groupBy(*KEY, "run").agg(F.count("*").alias("n"), F.min("gold").alias("lo"), F.max("gold").alias("hi"))
    keys = once.groupBy(*KEY).agg(F.collect_list(F.struct("run", "n", "lo", "hi")).alias("of"))
    of = lambda name: F.get(F.filter("of", lambda x: x["run"] == name), F.lit(0))
    each = keys.join(F.broadcast(names)).select("split", "wanted", of(F.lit(base)).alias("b"), "of", F.explode("names").alias("run"))  # the names are one row
    each = each.withColumn("m", of(F.col("run")))
    has, base_has = F.col("m").isNotNull(), F.col("b").isNotNull()
    other = has & base_has & ~(F.col("m.lo").eqNullSafe(F.col("b.lo")) & F.col("m.hi").eqNullSafe(F.col("b.lo")))
    got = each.groupBy("run", "split").agg(
        F.first(F.array_contains("wanted", F.col("run"))).alias("expected"), F.count_if(base_has).alias("n_base"), F.coalesce(F.sum("m.n"), F.lit(0).cast("long")).alias("n"),
        F.count_if(base_has & ~has).alias("n_missing"), F.count_if(has & ~base_has).alias("n_extra"), F.count_if(F.col("m.n") > 1).alias("n_repeated"), F.count_if(other).alias("n_other_gold"),
    )
    anywhere = F.sum("n").over(Window.partitionBy("run"))
    off = F.col("n_missing") + F.col("n_extra") + F.col("n_repeated") + F.col("n_other_gold") > 0
    status = F.when(F.col("anywhere") == 0, "missing").when(F.col("n") == 0, "no split").when(off, "misaligned").otherwise("aligned")
    return got.withColumn("anywhere", anywhere).where("n_base > 0").withColumn("status", status).drop("anywhere")


def metric_slots(runs: DataFrame, resamples: int, seed: str) -> DataFrame:
    """``(run, split, b, metric, value)`` of every resample of records, the plain values at b = -1. All runs
    see the same weights; a resample without a record of a split has no row there."""
    rows = answers(runs).withColumn("bin", D.bin_index(F.col("top1")))
    of = {"w": F.lit(1), "h": F.col("hit"), "c": F.col("top1"), "s": D.brier(F.col("probs"), F.col("gold")), "l": D.nll(F.col("probs"), F.col("gold"))}
    bins = slot_sums(rows, ["run", "split", "bin"], of, resamples, seed)
    sums = bins.groupBy("run", "split", "b").agg(*[F.sum(v).alias(v) for v in of], F.sum(F.abs(F.col("h") - F.col("c"))).alias("gap")).where("w > 0")
    values = [F.struct(F.lit(m).alias("metric"), (F.col(v) / F.col("w")).alias("value")) for m, v in zip(METRICS, ["h", "gap", "s", "l"], strict=True)]
    return sums.select("run", "split", "b", F.inline(F.array(*values)))


def terms_table(spark: SparkSession, contrasts: dict[str, list[tuple]]) -> DataFrame:
    """The terms of contrasts: ``(arm, n, seed, noise, factor)`` each; a seed of None is the mean of the
    seeds that are there."""
    return spark.createDataFrame([(name, i, *t[:4], float(t[4])) for name, terms in contrasts.items() for i, t in enumerate(terms)], TERMS)


def learner_contrasts(base: str, arms: list[str], sizes: list[int], pairs: list[tuple[str, str]], full: int, noise: str = "noisy") -> dict[str, list[tuple]]:
    """The usual contrasts as terms.

    Arms and pairs of arms along the sizes of training sets; every arm against the base; at the full size
    the means of seeds, their differences, noisy against clean training, and the difference of these.
    """
    zero = (base, 0, 0, None, -1)
    out = {base: [(base, 0, 0, None, 1)]}
    for n in sizes:
        for a in arms:
            out[f"{a}@{n}"] = [(a, n, 0, None, 1)]
            out[f"{a}@{n} - {base}"] = [(a, n, 0, None, 1), zero]
        for a, b in pairs:
            out[f"{a}@{n} - {b}@{n}"] = [(a, n, 0, None, 1), (b, n, 0, None, -1)]
    for a in arms:
        out[f"mean({a}@{full})"] = [(a, full, None, None, 1)]
        out[f"{noise} {a} - {a}"] = [(a, full, 0, noise, 1), (a, full, 0, None, -1)]
    for a, b in pairs:
        out[f"mean({a}@{full}) - {b}@{full}"] = [(a, full, None, None, 1), (b, full, 0, None, -1)]
        out[f"mean({a}@{full}) - mean({b}@{full})"] = [(a, full, None, None, 1), (b, full, None, None, -1)]
        out[f"({noise} {a} - {a}) - ({noise} {b} - {b})"] = [(a, full, 0, noise, 1), (a, full, 0, None, -1), (b, full, 0, noise, -1), (b, full, 0, None, 1)]
    return out


def members(status: DataFrame, terms: DataFrame, parts: list[Column]) -> DataFrame:
    """``(contrast, split, term, run, factor)``: the aligned runs of each term in each split of the base, a
    mean's factor divided among them; a term without a run keeps one row with a null."""
    there = status.where("status = 'aligned'").select("split", "run", *parts)
    splits = status.groupBy().agg(F.array_sort(F.collect_set("split")).alias("splits"))
    wanted = terms.join(F.broadcast(splits)).withColumn("split", F.explode("splits")).drop("splits").alias("t")  # the splits are one row
    of = there.alias("r")
    same = (F.col("t.split") == F.col("r.split")) & (F.col("t.arm") == F.col("r.arm")) & (F.col("t.n") == F.col("r.n")) & F.col("t.noise").eqNullSafe(F.col("r.noise"))
    found = wanted.join(of, same & (F.col("t.seed").isNull() | (F.col("t.seed") == F.col("r.seed"))), "left")
    k = F.count("r.run").over(Window.partitionBy("t.contrast", "t.split", "t.term"))
    return found.select("t.contrast", "t.split", "t.term", "r.run", F.when(k > 0, F.col("t.factor") / k).otherwise(F.col("t.factor")).alias("factor"))


def compared_runs(runs: DataFrame, status: DataFrame, contrasts: dict[str, list[tuple]], resamples: int, seed: str, parts: list[Column] | None = None) -> DataFrame:
    """``(contrast, split, metric, n_runs, n_absent, value, ci_lo, ci_hi)``: every contrast in every split.

    Each resample weighs the records alike for all runs, so an interval is that of the paired difference. A
    contrast with a term that no aligned run answers (``n_absent`` of them) has nulls for its values.
    """
    spark = runs.sparkSession
    of = members(status, terms_table(spark, contrasts), parts or parsed_run_name(F.col("run")))
    whole = of.groupBy("contrast", "split").agg(F.count("run").alias("n_runs"), F.count_if(F.col("run").isNull()).alias("n_absent"))
    complete = of.join(whole.where("n_absent = 0").select("contrast", "split"), ["contrast", "split"])
    kept = runs.join(F.broadcast(status.where("status = 'aligned'").select("run", "split")), ["run", "split"])  # one row a run and split
    per = metric_slots(kept, resamples, seed).join(complete, ["run", "split"])
    drawn = per.groupBy("contrast", "split", "metric", "b").agg(F.sum(F.col("value") * F.col("factor")).alias("d"))
    lo, hi = interval(F.when(F.col("b") >= 0, F.col("d")), "ci")
    got = drawn.groupBy("contrast", "split", "metric").agg(F.max(F.when(F.col("b") < 0, F.col("d"))).alias("value"), lo, hi)
    rows = whole.withColumn("metric", F.explode(F.array(*map(F.lit, METRICS))))
    return rows.join(got, ["contrast", "split", "metric"], "left").select("contrast", "split", "metric", "n_runs", "n_absent", "value", "ci_lo", "ci_hi")
