"""Temperatures by Newton's method, known-noise targets, inversion of a flip channel."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.functions import distributions as D
from credence.functions.draws import uniform
from credence.session import discard, ship_code, stored

LOW, HIGH, POINTS = 0.05, 20.0, 61


def grid(lo: float = LOW, hi: float = HIGH, points: int = POINTS) -> list[float]:
    """Temperatures at equal ratios."""
    return [lo * (hi / lo) ** (i / (points - 1)) for i in range(points)]


def losses(rows: DataFrame, loss, by: list[str], points: list[float]) -> DataFrame:
    """Mean loss at each temperature, all in one pass.

    A row's losses at all temperatures are one array, made from its logits and their maximum; the
    slots are summed in place, so rows are neither multiplied nor shuffled.
    """
    return _slots(rows, loss, by, F.array(*map(F.lit, points)), len(points))


def _slots(rows: DataFrame, loss, by: list[str], points: Column, size: int) -> DataFrame:
    z = rows.withColumn("__z", D.logits(F.col("probs"))).withColumn("__m", F.array_max("__z"))
    each = z.select(*by, points.alias("__t"), F.transform(points, lambda t: loss(t)).alias("__l"))
    summed = each.groupBy(*by).agg(F.count("*").alias("n"), F.first("__t").alias("__t"), *[F.avg(F.get("__l", F.lit(i))).alias(f"__l{i}") for i in range(size)])
    slots = summed.select(*by, "n", "__t", F.posexplode(F.array(*[f"__l{i}" for i in range(size)])).alias("__i", "loss"))
    return slots.select(*by, F.get("__t", F.col("__i")).alias("t"), "loss", "n").where("t is not null")


def best(table: DataFrame, by: list[str]) -> DataFrame:
    """The temperature of least loss; of losses equal to 12 digits the smallest temperature."""
    return table.groupBy(*by).agg(F.min(F.struct(F.round("loss", 12).alias("l"), "t", "n")).alias("b")).select(*by, F.col("b.t").alias("temperature"), F.col("b.l").alias("loss"), F.col("b.n").alias("n"))


#: Slope of the mean loss by the logarithm of the temperature at which a fit ends, the passes it may
#: take, and the points of the coarse grid that brackets a loss with several minima.
FLAT, PASSES, BRACKET = 1e-10, 60, 17


def _scores(rows: DataFrame, by: list[str], kind: str) -> DataFrame:
    """The logits less their maximum (``z``), the score whose tempered log-probability is asked for (``s``), and
    an outcome (``r``): all that a loss needs at any temperature."""
    z = rows.withColumn("z", D.let(D.logits(F.col("probs")), lambda z: D.let(F.array_max(z), lambda m: F.transform(z, lambda x: x - m))))
    if kind == "theta":
        return z.where("size(z) > 0").select(*by, "z", D.dot(F.col("z"), theta(F.size("probs"), F.col("gold"))).alias("s"), F.lit(1.0).alias("r"))
    at, r = ("action", F.col("outcome").cast("double")) if kind == "outcome" else ("gold", F.lit(1.0))
    return z.select(*by, "z", D.at(F.col("z"), F.col(at)).alias("s"), r.alias("r")).where("size(z) > 0 and s is not null and r is not null")


def _derivatives(kind: str, x: np.ndarray, z: np.ndarray, size: np.ndarray, s: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """The losses of rows at the temperatures ``exp(x)`` and their first and second derivatives by ``x``, from
    the mean and variance of the logits (``z``, those of all rows, ``size`` of each) under the tempered
    distributions."""
    b, at = np.exp(-x), np.cumsum(size) - size
    w = np.exp(np.repeat(b, size) * z)
    total, first, second = (np.add.reduceat(v, at) for v in (w, w * z, w * z * z))
    m = first / total
    said, d, v = b * s - np.log(total), s - m, second / total - m * m  # log-probability, its slope by 1/T and, negative, its bend
    if kind != "outcome":
        return -said, b * d, b * b * v - b * d
    p = np.exp(said)
    q = np.clip(p, D.OUTCOME_CLIP, 1 - D.OUTCOME_CLIP)
    odds, inside = (1 - r) * q / (1 - q), p == q  # beyond the clip the loss is flat
    slope, bend = odds * d - r * d, r * v + odds * (d * d / (1 - q) - v)
    return -(r * np.log(q) + (1 - r) * np.log(1 - q)), np.where(inside, -b * slope, 0), np.where(inside, b * b * bend + b * slope, 0)


def _means(rows: DataFrame, kind: str, x: Column, by: list[str]) -> DataFrame:
    """Mean loss, slope and bend of each group: a row's terms are made in Arrow batches, since its few
    exponentials by interpreted lambdas took ten times as long, and are summed where they are."""
    keys = rows.select(*by, x.alias("__x"), "z", "s", "r")
    names = ["loss", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, at, z, s, r = batch.columns
            if batch.num_rows:
                got = _derivatives(kind, at.to_numpy(), z.flatten().to_numpy(), np.diff(z.offsets.to_numpy()), s.to_numpy(), r.to_numpy())
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, got)], names=[*by, *names])

    ship_code(rows.sparkSession)
    kinds = T.StructType([*keys.select(*by).schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return keys.mapInArrow(run, kinds).groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])


def fitted(rows: DataFrame, kind: str, by: list[str]) -> DataFrame:
    """The temperature that minimises the mean loss of each group, the loss there and the group's rows.

    Newton's method on the logarithm of the temperature, inside a bracket that the sign of the slope
    narrows; where the step leaves the bracket or the loss bends down, the bracket is halved. Rows without
    probabilities or target are left out. The logits are written once, and a pass adds up loss, slope and curvature of each group at its temperature:
    the state is one row a group. A group is done at a slope of ``FLAT``; at an end of the range the end
    is the answer. The losses ``nll`` and ``theta`` fall to one minimum; ``outcome`` may have several,
    and a coarse grid first brackets the least. A row whose key is an array counts in each of its groups.
    """
    kept = scores = stored(_scores(rows, by, kind))
    for c in by:
        if dict(rows.dtypes)[c].startswith("array"):
            scores = scores.withColumn(c, F.explode(c))
    joined = lambda a, b: a.join(b, by) if by else a.join(F.broadcast(b))  # noqa: E731  one row without groups
    lo, hi = math.log(LOW), math.log(HIGH)
    state = scores.groupBy(*by).agg(F.count("*").alias("n")).where("n > 0")
    if kind == "outcome":
        wide = (hi - lo) / (BRACKET - 1)
        points = scores.withColumn("__p", F.explode(F.array(*[F.lit(lo + wide * i) for i in range(BRACKET)])))
        grid_losses = _means(points, kind, F.col("__p"), [*by, "__p"])
        state = joined(state, grid_losses.groupBy(*by).agg(F.min(F.struct(F.round("loss", 12), "__p"))["__p"].alias("x")))
        state = state.withColumns({"lo": F.greatest(F.lit(lo), F.col("x") - wide), "hi": F.least(F.lit(hi), F.col("x") + wide)})
    else:
        state = state.withColumns({"x": F.lit(0.0), "lo": F.lit(lo), "hi": F.lit(hi)})
    none = F.lit(None).cast("double")
    state = stored(state.withColumns({"done": F.lit(False), "loss": none, "d1": none, "d2": none}))
    for _ in range(PASSES):
        ahead = state.where("not done").drop("loss", "d1", "d2")
        sums = _means(joined(scores, ahead.select(*by, "x")), kind, F.col("x"), by)
        new = stored(state.where("done").unionByName(_moved(joined(ahead, sums))))
        discard(state)
        state = new
        if state.where("not done").isEmpty():
            break
    discard(kept)
    return state.select(*by, F.exp("x").alias("temperature"), F.round("loss", 12).alias("loss"), "n")


def _moved(state: DataFrame) -> DataFrame:
    """The next temperature of each group, or none where the slope is flat or the bracket closed."""
    x, slope, bend = F.col("x"), F.col("d1"), F.col("d2")
    lo, hi = F.when(slope < 0, x).otherwise(F.col("lo")), F.when(slope > 0, x).otherwise(F.col("hi"))
    step = F.when(bend > 0, x - slope / bend)
    # a first step beyond an end of the range tries the end itself
    end = F.when(step <= F.col("lo"), F.col("lo")).when(step >= F.col("hi"), F.col("hi"))
    to = F.when((step > lo) & (step < hi), step).when(end.isNotNull() & (end != x), end).otherwise((lo + hi) / 2)
    done = (F.abs(slope) <= FLAT) | (hi - lo < 1e-14) | ((x == F.col("lo")) & (slope > 0)) | ((x == F.col("hi")) & (slope < 0))
    return state.withColumns({"x": F.when(done, x).otherwise(to), "lo": lo, "hi": hi, "done": F.coalesce(done, F.lit(True))})


def _at(t: Column) -> Column:
    """The sum of the exponentials of the logits, less their maximum, at a temperature."""
    return F.aggregate("__z", F.lit(0.0), lambda a, x: a + F.exp((x - F.col("__m")) / t))


def _log_normaliser(t: Column) -> Column:
    return F.log(_at(t)) + F.col("__m") / t


def nll_loss(t: Column) -> Column:
    return _log_normaliser(t) - D.at(F.col("__z"), F.col("gold")) / t


def scaled(results: DataFrame, t: float) -> DataFrame:
    """Results at a temperature, the answer to the negated question and a reordered copy included."""
    out = results.withColumn("probs", D.tempered(F.col("probs"), t))
    if "negated_p_yes" in results.columns:
        n = F.col("negated_p_yes")
        out = out.withColumn("negated_p_yes", F.when(n.isNotNull(), D.at(D.tempered(F.array(n, 1 - n), t), F.lit(0))))
    if "shuffled_probs" in results.columns:
        out = out.withColumn("shuffled_probs", D.tempered(F.col("shuffled_probs"), t))
    return out


def inverted(results: DataFrame, f: float) -> DataFrame:
    return results.withColumn("probs", D.inverted(F.col("probs"), f))


def channel(judged: DataFrame, f: float, confidence: Column) -> DataFrame:
    """Confidence and target on the flip channel's scale."""
    return judged.withColumns({"conf": confidence, "target": f + (1 - 2 * f) * F.col("hit")})


# --- known-noise environment ---------------------------------------------------------------------------


def eta(k: Column) -> Column:
    """The noise of a question with k options."""
    return F.least(F.lit(0.40), 0.05 + 0.03 * (k - 2))


def theta(k: Column, gold: Column) -> Column:
    """The environment's distribution: one minus the noise on the gold option, the rest spread evenly."""
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(i == gold, 1 - eta(k)).otherwise(eta(k) / (k - 1)))


def accepted(k: Column, gold: Column, stream: str, *key: Column) -> Column:
    """The accepted answer: gold, or with the noise's probability another option, evenly."""
    other = F.floor(uniform(f"{stream}:which", *key) * (k - 1)).cast("int")
    return F.when(uniform(f"{stream}:noise", *key) < 1 - eta(k), gold).otherwise(other + (other >= gold).cast("int"))


def cross_entropy(p: Column, target: Column) -> Column:
    return D.total(F.zip_with(p, target, lambda x, t: -t * F.log(F.greatest(x, F.lit(D.NLL_FLOOR)))))


def environment_rows(judged: DataFrame) -> DataFrame:
    """Per question the scores against theta and their minima."""
    p = D.let(D.total(F.col("probs")), lambda s: F.transform("probs", lambda x: x / s))
    j = judged.withColumns({"p": p, "theta": theta(F.col("k"), F.col("gold"))})
    p, t = F.col("p"), F.col("theta")
    return j.withColumns({
        "brier_theta": D.dot(p, p) - 2 * D.dot(p, t) + 1, "brier_min": 1 - D.dot(t, t), "ce": cross_entropy(p, t), "entropy": cross_entropy(t, t),
        "p_gold": D.at(p, F.col("gold")), "top1": F.array_max(p), "top1_hit": D.at(t, F.col("prediction")), "one_minus_eta": 1 - eta(F.col("k")),
    })


def by_k(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    a = rows.groupBy(*(by or []), "k").agg(F.count("*").alias("count"), F.avg("top1").alias("mean_top1"), F.avg("p_gold").alias("mean_p_gold"),
                                           F.avg("one_minus_eta").alias("one_minus_eta"), F.avg("top1_hit").alias("expected_top1_hit"))
    return a.withColumns({"gap": F.col("mean_top1") - F.col("expected_top1_hit"), "gap_gold": F.col("mean_p_gold") - F.col("one_minus_eta")})


def calibration_gap(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    return table.groupBy(*(by or [])).agg((F.sum(F.col("count") * F.abs("gap")) / F.sum("count")).alias("calibration_gap"))


def environment_metrics(rows: DataFrame, by: list[str], stream: str) -> DataFrame:
    """Every mean against theta, the calibration gap, and ECE against outcomes drawn once."""
    from credence.operators.metrics import ece

    means = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("brier_theta").alias("expected_brier"), F.avg("brier_min").alias("brier_min"),
        F.avg("ce").alias("cross_entropy"), F.avg("entropy").alias("entropy"), F.avg(F.col("ce") - F.col("entropy")).alias("kl"),
    )
    drawn = rows.withColumn("hit", (F.col("prediction") == accepted(F.col("k"), F.col("gold"), stream, F.col("record_id"), F.col("question_id"))).cast("int"))
    e = ece(drawn, by).select(*by, F.col("ece").alias("sampled_ece"))
    return means.join(calibration_gap(by_k(rows, by), by), by).join(e, by)


def bandit_samples(results: DataFrame, size: int, epsilon: float, seed: str) -> DataFrame:
    """Actions from the behaviour policy, with outcomes from one accepted answer per question."""
    from credence.operators.feedback import group_draws

    d = group_draws(results, size, epsilon, seed)
    a = accepted(F.col("k"), F.col("gold"), f"{seed}:env", F.col("record_id"), F.col("question_id"))
    d = d.withColumn("outcome", (F.col("action") == a).cast("int")).select("record_id", "question_id", "g", "action", "outcome")
    return d.join(results.select("record_id", "question_id", "probs"), ["record_id", "question_id"])


def binary_entropy(f: Column) -> Column:
    """The least mean log-loss that outcomes flipped at a rate allow."""
    g = 1 - f
    return F.when((f <= 0) | (f >= 1), 0.0).otherwise(-(f * F.log(f) + g * F.log(g)))
