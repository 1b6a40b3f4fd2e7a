"""The report of a split: headline metrics with intervals, the form block apart, and every breakdown.

One long table ``(split, block, part, metric, value)``. Blocks are ``overall`` and the question types,
both over the questions whose answer depends on a label, and ``form`` for yes/no questions about a
text's form, which so never move the headline. Parts are ``all`` or a breakdown of the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions import distributions as D
from credence.operators import metrics as M
from credence.operators import resampling as R
from credence.operators.helpers import is_form
from credence.session import stored

BY = ["split", "block"]


def _means() -> dict[str, Column]:
    """The values of a row by the metric that their mean is."""
    p, g, said = F.col("probs"), F.col("gold"), F.col("prediction")
    return {
        "accuracy": F.col("hit"), "brier": D.brier(p, g), "nll": D.nll(p, g), "yes_rate": (said == 0).cast("int"), "mean_gold_probability": D.at(p, g),
        "predicted_other_rate": (D.at(F.col("labels"), said) == "other").cast("int"), "mae": F.abs(D.expected_level(p) - g),
    }


def blocks(judged: DataFrame) -> DataFrame:
    """``judged`` with ``type``, the block of its type: the question type, or form."""
    form = (F.col("qtype") == "noul") & is_form(F.col("kind"))
    return judged.withColumn("type", F.when(form, "form").otherwise(F.col("qtype")))


def _keys() -> Column:
    """The blocks and parts that a row counts in."""
    t = F.col("type")
    key = lambda block, part: F.struct(block.alias("block"), part.alias("part"))
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    some = [
        key(F.when(t != "form", F.lit("overall")), F.lit("all")), key(t, F.lit("all")),
        key(t, text("place:", F.when(F.col("position") == 0, "first").otherwise("later"))),
        key(F.when(t.isin("noul", "form"), t), text("kind:", F.col("kind"))),
    ]
    choice, offers = F.when(t == "choice", t), F.array_contains("labels", "other")
    other = F.when(D.at(F.col("labels"), F.col("gold")) == "other", "gold_other").otherwise("gold_named")
    letters = [text("k:", F.col("k")), text("gold:", F.col("gold")), text("k:", F.col("k"), "/gold:", F.col("gold"))]
    some += [key(choice, p) for p in letters] + [key(F.when(offers, choice), p) for p in (F.lit("offering"), other)]
    return F.filter(F.array(*some), lambda s: s["block"].isNotNull())


def _shown(block: Column, part: Column) -> list[tuple[str, Column]]:
    """Which metrics a part has."""
    whole, letter, other = part == "all", part.rlike("^(k|gold):"), part.isin("offering", "gold_other", "gold_named")
    yes = block.isin("noul", "form")
    plain = whole | part.startswith("place:") | part.startswith("kind:")
    return [
        ("n", F.lit(True)), ("accuracy", F.lit(True)), ("ece", plain), ("brier", whole), ("nll", whole), ("yes_rate", yes & (whole | part.startswith("kind:"))),
        ("mean_gold_probability", letter), ("predicted_other_rate", other), ("mae", (block == "score") & whole),
    ]


def _long(table: DataFrame, by: list[str], metrics: list[tuple[str, Column]] | list[str]) -> DataFrame:
    pairs = [(m, F.lit(True)) if isinstance(m, str) else m for m in metrics]
    every = F.array(*[F.when(ok, F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))) for m, ok in pairs])
    return table.select(*by, F.explode(F.filter(every, lambda x: x.isNotNull())).alias("m")).select(*by, "m.metric", "m.value")


def intervals(typed: DataFrame, resamples: int, seed: str) -> DataFrame:
    """95 percent intervals of accuracy and ECE by record-level weights, for types and overall."""
    rows = typed.withColumn("bin", D.bin_index(F.col("top1")))
    cells = R.slot_sums(rows, ["split", "type", "bin"], {"n": F.lit(1), "h": F.col("hit"), "c": F.col("top1")}, resamples, seed).where("b >= 0")
    named = F.explode(F.when(F.col("type") == "form", F.array("type")).otherwise(F.array(F.lit("overall"), "type"))).alias("block")
    cells = cells.select("*", named).groupBy(*BY, "b", "bin").agg(*[F.sum(x).alias(x) for x in "nhc"])
    return R.intervals(R.accuracy_and_ece(cells, [*BY, "b"]), BY)


def split_report(judged: DataFrame, resamples: int = 1000, seed: str = "report") -> DataFrame:
    """The report. The judged rows are written once; no block reads the inputs again."""
    by = [*BY, "part"]
    judged = stored(judged)
    typed, means = blocks(judged), _means()
    keyed = typed.withColumn("key", F.explode(_keys())).select("split", "key.*", D.bin_index(F.col("top1")).alias("bin"), "top1", *[c.alias(m) for m, c in means.items()])
    cells = keyed.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum("top1").alias("c"), *[F.sum(m).alias(m) for m in means])
    gap = F.sum(F.abs(F.col("accuracy") - F.col("c"))) / F.sum("n")
    totals = cells.groupBy(*by).agg(F.sum("n").alias("n"), gap.alias("ece"), *[(F.sum(m) / F.sum("n")).alias(m) for m in means])
    out = _long(totals, by, _shown(F.col("block"), F.col("part")))
    bins = cells.where("part = 'all'").select(*BY, F.concat(F.lit("bin:"), F.col("bin").cast("string")).alias("part"), F.col("n").alias("count"), (F.col("c") / F.col("n")).alias("mean_confidence"), (F.col("accuracy") / F.col("n")).alias("mean_accuracy"))
    out = out.unionByName(_long(bins, by, ["count", "mean_confidence", "mean_accuracy"]))
    ends = intervals(typed, resamples, seed).withColumn("part", F.lit("all"))
    out = out.unionByName(_long(ends, by, ["accuracy_lo", "accuracy_hi", "ece_lo", "ece_hi"]))
    each = typed.withColumn("block", F.col("type"))
    curve = M.coverage_curve(each, BY).withColumn("part", F.concat(F.lit("threshold:"), F.format_number("threshold", 2)))
    out = out.unionByName(_long(curve, by, ["coverage", "n", "accuracy"]))
    risk = M.risk_coverage_block(each, BY).withColumn("part", F.concat(F.lit("risk:"), "ranking", F.lit(":"), F.format_number("budget", 2)))
    area = F.struct(F.concat(F.lit("risk:"), "ranking").alias("part"), F.lit("aurc").alias("metric"), F.col("aurc").alias("value"))
    kept = [F.struct("part", F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("coverage", "n", "accuracy", "threshold")]
    once = F.when(F.col("budget") == min(D.BUDGETS), F.array(area)).otherwise(F.array().cast("array<struct<part:string,metric:string,value:double>>"))
    out = out.unionByName(risk.select(*BY, F.explode(F.concat(F.array(*kept), once)).alias("m")).select(*BY, "m.*"))
    f1 = M.macro_f1(each.where("type = 'choice'"), BY).withColumn("part", F.lit("all"))
    out = out.unionByName(_long(f1, by, ["macro_f1"]))
    levels = M.score_levels(each.where("type = 'score'"), BY)
    levels = levels.withColumn("part", F.concat(F.lit("levels:"), F.col("k").cast("string"), F.lit("/"), "where", F.lit("/"), F.col("level").cast("string")))
    out = out.unionByName(_long(levels, by, ["predicted_share", "gold_share"]))
    pairs = each.where("qtype = 'noul' and negated_p_yes is not null")
    pairs = pairs.select(*BY, F.explode(F.array(F.lit("symmetry"), F.concat(F.lit("symmetry:"), "kind"))).alias("part"), *M.symmetry_terms())
    even = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("s").alias("mean_sum"), F.stddev_pop("s").alias("std_sum"), F.avg("c").alias("argmax_consistent"))
    out = out.unionByName(_long(even, by, ["n", "mean_sum", "std_sum", "argmax_consistent"]))
    records = judged.groupBy("split").agg(F.count_distinct("record_id").alias("n_records")).select("split", F.lit("overall").alias("block"), F.lit("all").alias("part"), "n_records")
    out = out.unionByName(_long(records, by, ["n_records"]))
    if "shuffled_probs" in judged.columns:
        order = each.where("shuffled_probs is not null").withColumn("block", F.when(F.col("type") == "form", "form").otherwise("overall"))
        moved = M.order_sensitivity(order, BY).withColumn("part", F.concat(F.lit("order:"), "qtype"))
        out = out.unionByName(_long(moved, by, ["n", "accuracy", "accuracy_shuffled", "prediction_agreement", "mean_max_abs_difference", "max_abs_difference"]))
    return out


def long_rows(table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Named columns of a wide table as rows ``(*keys, metric, value)``; nulls stay."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return table.select(*keys, F.inline(pairs))


def report_rows(results: DataFrame, replies: DataFrame, footers: DataFrame, expected: list[str]) -> DataFrame:
    """``(run, kind, split, metric, value, n, incomplete)``: runs of every source in one table.

    ``results`` and ``replies`` are ``(run, split, n, metric, value)`` of runs with probabilities and of runs
    with parsed replies; a run is taken from the former where it is in both. A reply run is incomplete where
    it has fewer records than the runs with probabilities have in that split. ``footers`` are ``(run, metric,
    value)``: latency, cost, temperatures. Expected runs in neither source are ``missing``, and those
    without a footer get an empty one. One row a run, split and metric, so every side is small.
    """
    kept = replies.join(results.select("run").distinct(), "run", "left_anti")
    blocks = results.withColumn("kind", F.lit("results")).unionByName(kept.withColumn("kind", F.lit("replies")))
    full = results.groupBy("split").agg(F.max("n").alias("full"))
    blocks = blocks.join(full, "split", "left").withColumn("incomplete", F.coalesce((F.col("kind") == "replies") & (F.col("n") < F.col("full")), F.lit(False)))
    names = results.sparkSession.createDataFrame([(e,) for e in expected], "run string")
    gone = names.join(blocks.select("run").distinct(), "run", "left_anti").withColumn("kind", F.lit("missing"))
    feet = footers.unionByName(names.join(footers.select("run").distinct(), "run", "left_anti"), allowMissingColumns=True).withColumn("kind", F.lit("footer"))
    out = blocks.drop("full").unionByName(gone, allowMissingColumns=True).unionByName(feet, allowMissingColumns=True)
    return out.select("run", "kind", "split", "metric", "value", "n", "incomplete")
