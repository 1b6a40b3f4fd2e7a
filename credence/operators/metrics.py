"""Calibration and selective-prediction metrics over a table of answers.

All of them are aggregations with map-side partial sums. Curves over a ranking reduce the rows to
groups of tied values first and take running sums in two levels (ranges of values, then inside a
range), so that no task needs all rows of a split in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions import distributions as D

RANGES = 512


def answers(results: DataFrame) -> DataFrame:
    """Results with their derived columns: k, prediction, top1, confidence, hit."""
    p, q = F.col("probs"), F.col("qtype")
    out = results.withColumns({"k": F.size(p), "prediction": D.prediction(q, p), "top1": F.array_max(p), "confidence": D.confidence(q, p)})
    return out.withColumn("hit", (F.col("prediction") == F.col("gold")).cast("int"))


def reliability(judged: DataFrame, by: list[str], n_bins: int = D.N_BINS, value: str = "top1", target: str = "hit") -> DataFrame:
    """Equal-width bins with counts and means; empty bins stay, with null means."""
    binned = judged.groupBy(*by, D.bin_index(F.col(value), n_bins).alias("bin")).agg(
        F.count("*").alias("count"), F.avg(value).alias("mean_confidence"), F.avg(target).alias("mean_accuracy")
    )
    every = binned.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return every.join(binned, [*by, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def ece(judged: DataFrame, by: list[str], n_bins: int = D.N_BINS, value: str = "top1", target: str = "hit") -> DataFrame:
    """Sum over bins of |sum of targets - sum of confidences| over the count of all."""
    bins = judged.groupBy(*by, D.bin_index(F.col(value), n_bins).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.sum(target) - F.sum(value)).alias("gap"))
    return bins.groupBy(*by).agg((F.sum("gap") / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def proper_scores(judged: DataFrame, by: list[str]) -> DataFrame:
    p, g = F.col("probs"), F.col("gold")
    return judged.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg(D.brier(p, g)).alias("brier"), F.avg(D.nll(p, g)).alias("nll")
    )


def macro_f1(judged: DataFrame, by: list[str]) -> DataFrame:
    """F1 averaged over the labels that occur as gold."""
    named = judged.select(*by, "hit", F.array(
        F.struct(D.at(F.col("labels"), F.col("gold")).alias("label"), F.lit(1).alias("is_gold")),
        F.struct(D.at(F.col("labels"), F.col("prediction")).alias("label"), F.lit(0).alias("is_gold")),
    ).alias("roles"))
    roles = named.withColumn("r", F.explode("roles")).select(*by, "hit", "r.*")
    counts = roles.groupBy(*by, "label").agg(
        F.sum(F.when(F.col("is_gold") == 1, F.col("hit")).otherwise(0)).alias("tp"), F.sum("is_gold").alias("golds"), F.count("*").alias("both")
    )
    # 2 tp + fp + fn is the number of times the label is gold or predicted
    return counts.where("golds > 0").groupBy(*by).agg(F.avg(2 * F.col("tp") / F.col("both")).alias("macro_f1"), F.count("*").alias("n_labels"))


def coverage_curve(judged: DataFrame, by: list[str], value: str = "confidence") -> DataFrame:
    """At each threshold the share kept and its accuracy: counts by the number of thresholds passed,
    then sums from the top over those few rows."""
    every = F.array(*map(F.lit, D.THRESHOLDS))
    passed = F.size(F.filter(every, lambda t: F.col(value) >= t - D.SLACK))
    counts = judged.groupBy(*by, passed.alias("passed")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    rows = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(D.THRESHOLDS) - 1))))
    kept = F.col("i") < F.col("passed")
    summed = rows.groupBy(*by, "i").agg(F.sum("n").alias("all_n"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(kept, F.col("hits")).otherwise(0)).alias("hits"))
    return summed.select(*by, every[F.col("i")].alias("threshold"), (F.col("n") / F.col("all_n")).alias("coverage"), "n",
                         F.when(F.col("n") > 0, F.col("hits") / F.col("n")).alias("accuracy"))


def running_ties(judged: DataFrame, by: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Tie groups of a ranking with their weight ``w`` and errors ``e``, those of all higher groups
    (``w0``, ``e0``), and the total weight.

    The values, between 0 and 1, are cut into ranges; sums over ranges are few rows, and sums inside
    a range need the groups of that range only.
    """
    weight = F.lit(1) if weight is None else weight
    ties = judged.groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight).alias("w"), F.sum(weight * (1 - F.col("hit"))).alias("e"))
    ties = ties.where("w > 0").withColumn("range", F.least(F.floor(F.col("v") * RANGES), F.lit(RANGES - 1)))
    ranges = ties.groupBy(*by, "range").agg(F.sum("w").alias("rw"), F.sum("e").alias("re"))
    above = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns({
        "base_w": F.coalesce(F.sum("rw").over(above), F.lit(0)), "base_e": F.coalesce(F.sum("re").over(above), F.lit(0)),
        "total": F.sum("rw").over(Window.partitionBy(*by)),
    }).drop("rw", "re")
    inside = Window.partitionBy(*by, "range").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumns({"w0": F.coalesce(F.sum("w").over(inside), F.lit(0)), "e0": F.coalesce(F.sum("e").over(inside), F.lit(0))})
    joined = ties.join(ranges, [*by, "range"])
    return joined.select(*by, "v", "w", "e", (F.col("w0") + F.col("base_w")).alias("w0"), (F.col("e0") + F.col("base_e")).alias("e0"), "total")


def harmonic(n: Column) -> Column:
    """Harmonic number: summed up to 32, by its expansion beyond (to 1e-14)."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(32))).cast("int")), F.lit(0.0), lambda a, i: a + 1 / i.cast("double"))
    large = F.log(x) + 0.57721566490153286 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0))) - 1 / (252 * F.pow(x, F.lit(6.0)))
    return F.when(n <= 0, 0.0).when(n <= 32, small).otherwise(large)


def _area(ties: DataFrame, by: list[str]) -> DataFrame:
    rate = F.col("e") / F.col("w")
    area = F.col("e") + (F.col("e0") - rate * F.col("w0")) * (harmonic(F.col("w0") + F.col("w")) - harmonic(F.col("w0")))
    return ties.groupBy(*by).agg((F.sum(area) / F.max("total")).alias("aurc"))


def aurc(judged: DataFrame, by: list[str], value: str = "top1", weight: Column | None = None) -> DataFrame:
    """Mean over ranks of the expected error rate down to that rank, over all orders of ties."""
    return _area(running_ties(judged, by, value, weight), by)


def _kept(ties: DataFrame, by: list[str], budgets: list[float]) -> DataFrame:
    t = ties.withColumns({"kept": F.col("w0") + F.col("w"), "errors": F.col("e0") + F.col("e")})
    t = t.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    ok = F.col("errors") / F.col("kept") <= F.col("budget") + D.SLACK
    best = t.groupBy(*by, "budget").agg(F.max(F.when(ok, F.struct("kept", "errors", "v"))).alias("b"), F.max("total").alias("total"))
    n = F.coalesce(F.col("b.kept"), F.lit(0))
    return best.select(*by, "budget", (n / F.col("total")).alias("coverage"), n.alias("n"),
                       (1 - F.col("b.errors") / F.col("b.kept")).alias("accuracy"), F.col("b.v").alias("threshold"))


def coverage_at_risk(judged: DataFrame, by: list[str], value: str = "top1", budgets: list[float] = D.BUDGETS) -> DataFrame:
    """For each error budget the largest share that a threshold keeps within it."""
    return _kept(running_ties(judged, by, value), by, budgets)


def risk_coverage_block(judged: DataFrame, by: list[str]) -> DataFrame:
    """Both rankings, from one pass over the answers: area and coverage at each budget."""
    ranked = F.explode(F.array(*[F.struct(F.lit(n).alias("ranking"), F.col(c).alias("rank_value")) for n, c in (("top1", "top1"), ("entropy", "confidence"))]))
    rows = judged.select(*by, "hit", ranked.alias("r")).select(*by, "hit", "r.*")
    by = ["ranking", *by]
    ties = running_ties(rows, by, "rank_value")
    return _kept(ties, by, D.BUDGETS).join(_area(ties, by), by).select(*by, "aurc", "budget", "coverage", "n", "accuracy", "threshold")


def letter_bias(judged: DataFrame) -> DataFrame:
    """Accuracy and mean probability of the gold option by its position, by K, and by both."""
    g = judged.select("k", F.col("gold").alias("gold_position"), "hit", D.at(F.col("probs"), F.col("gold")).alias("p"))
    return g.cube("k", "gold_position").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("p").alias("mean_gold_probability")
    ).where("level < 3").drop("level")


def noul_by_kind(judged: DataFrame) -> DataFrame:
    rest = judged.groupBy("kind").agg(F.avg("hit").alias("accuracy"), F.avg((F.col("prediction") == 0).cast("int")).alias("yes_rate"))
    return ece(judged, ["kind"]).join(rest, "kind")


def by_position(judged: DataFrame) -> DataFrame:
    where = F.when(F.col("position") == 0, "first").otherwise("later")
    j = judged.withColumn("where", where)
    return ece(j, ["where"]).join(j.groupBy("where").agg(F.avg("hit").alias("accuracy")), "where")


def score_levels(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Predicted and gold share of every level, by K and position of the question."""
    by = by or []
    where = F.when(F.col("position") == 0, "first").otherwise("later").alias("where")
    roles = judged.select(*by, "k", where, F.explode(F.array(F.struct(F.col("prediction").alias("level"), F.lit(1).alias("p"), F.lit(0).alias("g")),
                                                        F.struct(F.col("gold").alias("level"), F.lit(0).alias("p"), F.lit(1).alias("g")))).alias("r"))
    counts = roles.groupBy(*by, "k", "where", "r.level").agg(F.sum("r.p").alias("p"), F.sum("r.g").alias("g"))
    totals = counts.groupBy(*by, "k", "where").agg(F.sum("g").alias("n"))
    every = totals.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    got = every.join(counts, [*by, "k", "where", "level"], "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("n")
    return got.select(*by, "k", "where", "level", "n", share("p").alias("predicted_share"), share("g").alias("gold_share"))


def order_sensitivity(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``pairs`` has qtype, gold, probs and shuffled_probs; one row by type and one overall."""
    by = by or []
    q, g = F.col("qtype"), F.col("gold")
    a, b = D.prediction(q, F.col("probs")), D.prediction(q, F.col("shuffled_probs"))
    moved = F.array_max(F.zip_with("probs", "shuffled_probs", lambda x, y: F.abs(x - y)))
    rows = pairs.select(*by, F.explode(F.array("qtype", F.lit("overall"))).alias("qtype"), (a == g).cast("int").alias("h"), (b == g).cast("int").alias("s"), (a == b).cast("int").alias("same"), moved.alias("d"))
    return rows.groupBy(*by, "qtype").agg(
        F.count("*").alias("n"), F.avg("h").alias("accuracy"), F.avg("s").alias("accuracy_shuffled"), F.avg("same").alias("prediction_agreement"),
        F.avg("d").alias("mean_max_abs_difference"), F.max("d").alias("max_abs_difference"),
    )


def by_gold_other(judged: DataFrame, other: str = "other") -> DataFrame:
    """Questions that offer ``other``, split by whether it is the answer, and overall."""
    rows = judged.where(F.array_contains("labels", other)).select(
        F.when(D.at(F.col("labels"), F.col("gold")) == other, "gold_other").otherwise("gold_named").alias("part"), "hit",
        (D.at(F.col("labels"), F.col("prediction")) == other).cast("int").alias("said"),
    )
    out = rows.rollup("part").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("said").alias("predicted_other_rate"))
    return out.withColumn("part", F.coalesce("part", F.lit("offering")))


def symmetry_terms() -> list[Column]:
    """The sum of both answers, and whether they agree."""
    a, b = F.col("probs")[0], F.col("negated_p_yes")
    return [(a + b).alias("s"), ((a >= 0.5) != (b >= 0.5)).cast("int").alias("c")]


def symmetry(results: DataFrame) -> DataFrame:
    """How close P(yes to q) and P(yes to not q) come to summing to one, by kind and overall."""
    rows = results.where("negated_p_yes is not null").select("kind", *symmetry_terms())
    out = rows.rollup("kind").agg(F.count("*").alias("n"), F.avg("s").alias("mean_sum"), F.stddev_pop("s").alias("std_sum"), F.avg("c").alias("argmax_consistent"))
    return out.withColumn("kind", F.coalesce("kind", F.lit("overall")))


def max_abs_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference between two runs' probabilities; shapes that differ are counted."""
    j = a.select("record_id", "question_id", "probs").join(b.select("record_id", "question_id", F.col("probs").alias("other")), ["record_id", "question_id"])
    same = F.size("probs") == F.size("other")
    d = F.when(same, F.array_max(F.zip_with("probs", "other", lambda x, y: F.abs(x - y))))
    return j.agg(F.count("*").alias("n"), F.sum((~same).cast("int")).alias("mismatched"), F.max(d).alias("max_abs_difference"))


def quantiles(df: DataFrame, by: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, by running counts over distinct values: first over
    ranges of values, then inside a range, so that no task or buffer holds all values of a group."""
    v = F.col(value).cast("double")
    ties = df.where(v.isNotNull()).groupBy(*by, v.alias("v")).agg(F.count("*").alias("w"))
    ties = ties.withColumn("range", F.floor(F.signum("v") * F.log1p(F.abs("v")) * RANGES))  # grows with the value
    ranges = ties.groupBy(*by, "range").agg(F.sum("w").alias("rw"))
    below = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns({"base": F.coalesce(F.sum("rw").over(below), F.lit(0)), "total": F.sum("rw").over(Window.partitionBy(*by))}).drop("rw")
    inside = Window.partitionBy(*by, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = ties.withColumn("w0", F.coalesce(F.sum("w").over(inside), F.lit(0))).join(ranges, [*by, "range"])
    first = F.col("base") + F.col("w0")  # of the places 0, 1, ... that the value has
    out = []
    for name, q in names.items():
        at = (F.col("total") - 1) * F.lit(q)
        upto = lambda place: F.max(F.when(first <= place, F.col("v")))
        part = F.max(at - F.floor(at))
        lo, hi = upto(F.floor(at)), upto(F.ceil(at))
        out.append((lo + (hi - lo) * part).alias(name))
    return placed.groupBy(*by).agg(*out)


def timing_summary(df: DataFrame, seconds: str, by: list[str]) -> DataFrame:
    median = quantiles(df, by, seconds, {"median": 0.5}).select(*[F.col(c).alias(f"__{c}") for c in by], (F.col("median") * 1000).alias("median_ms"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    means = df.groupBy(*by).agg(F.count(seconds).alias("n"), (F.avg(seconds) * 1000).alias("mean_ms"))
    return means.join(median, same, "left").select(*by, "n", "median_ms", "mean_ms")


def split_metrics(judged: DataFrame) -> DataFrame:
    """One long table: for each split, overall, by type, by type and kind, and by type and place."""
    where = F.when(F.col("position") == 0, "first").otherwise("later")
    blocks = F.array(
        F.struct(F.lit("overall").alias("block"), F.lit("all").alias("name")),
        F.struct(F.lit("type").alias("block"), F.col("qtype").alias("name")),
        F.struct(F.lit("kind").alias("block"), F.concat_ws("/", "qtype", "kind").alias("name")),
        F.struct(F.lit("place").alias("block"), F.concat_ws("/", "qtype", where).alias("name")),
    )
    rows = judged.withColumn("b", F.explode(blocks)).select("*", "b.block", "b.name")
    by = ["split", "block", "name"]
    return proper_scores(rows, by).join(ece(rows, by).select(*by, "ece"), by)


def pooled_coverage(runs: DataFrame) -> DataFrame:
    """Coverage curves of several runs (column ``run``): coverage averaged, accuracy pooled by count."""
    c = coverage_curve(runs, ["run"])
    return c.groupBy("threshold").agg(F.avg("coverage").alias("coverage"), F.sum("n").alias("n"), (F.sum(F.col("accuracy") * F.col("n")) / F.sum(F.when(F.col("n") > 0, F.col("n")))).alias("accuracy"))


def seeded_order(items: Column, stream: str, key: Column) -> Column:
    """A seeded order of an array that differs from the stored one (rotated by one where it would not)."""
    from credence.functions.draws import digest

    keyed = F.transform(items, lambda x, i: F.struct(digest(stream, key, i).alias("d"), x.alias("x")))
    drawn = F.transform(F.array_sort(keyed), lambda s: s["x"])
    n = F.size(items)
    return F.when((drawn == items) & (n > 1), F.concat(F.slice(items, F.lit(2), n), F.slice(items, F.lit(1), F.lit(1)))).otherwise(drawn)
