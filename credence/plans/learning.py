"""Queries on calibration, environment, feedback logs and resampling, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions import distributions as D
from credence.operators import calibration as K
from credence.operators import feedback as B
from credence.operators import metrics as M
from credence.operators import resampling as R
from credence.plans import fixtures as X
from credence.plans.fixtures import oracle, sql_slots, sql_softmax, sql_uniform
from credence.plans.metrics import _PROPER, _RUNS, at_risk_sql, ece_sql, r, ranked_sql, rounded, choice, judged, runs
from credence.session import tables

RESAMPLES = PAIRED = 1000


def log(s, d):
    return X.interactions(s, d)


def run_b(s, d):
    return X.results_choice(s, d, 1.0)


def run_c(s, d):
    return X.results_choice(s, d, 0.05, 0.15)


#: Resamples and seed of paired comparisons.
BOOT = PAIRED, "boot"


def draws(s, d):
    return B.group_draws(X.results_choice(s, d), 4, 0.1, "h15")


def environment(s, d):
    return K.environment_rows(choice(s, d))


def learner_log(s, d):
    """The log's training prefix with another run's probabilities for its rows."""
    p = run_b(s, d).select("record_id", F.col("probs").alias("p"), F.col("labels").alias("l"))
    train = B.prefix(log(s, d), 400).where("part = 'train'")
    return train.join(p, "record_id").where(F.col("l") == F.col("labels")).drop("probs").withColumnRenamed("p", "probs")


def simulated(s, d):
    out = None
    g = draws(s, d)
    for arm in B.ARMS:
        one = B.simulate(g, arm)
        out = one if out is None else out.unionByName(one)
    return out


def sign_checks(s, d):
    """Every arm's gradients over the draws of all questions."""
    q, g = X.results_choice(s, d), draws(s, d)
    rows = [B.gradient_check(B.logit_gradients(q, g, arm), arm) for arm in B.ARMS]
    return reduce(DataFrame.unionByName, rows)


def enumerated(s, d):
    """Closed form and enumeration for two-option questions."""
    q = X.results_noul(s, d).where("position = 0")
    e = B.enumerated_gold_step(q, "brier", 3, 0.1, 1e9)
    c = q.select("record_id", "question_id", B.expected_gold_step(F.col("probs"), F.col("gold"), "brier", 3).alias("closed"))
    return e.join(c, ["record_id", "question_id"]).agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("step") - F.col("closed"))), 8).alias("max_abs_difference"), D.r6(F.avg("step")).alias("mean_step"))


def contrast_table(s, d):
    m = R.run_metrics(runs(s, d), *BOOT)
    of = {"a-c": {"a": 1, "c": -1}, "mean(a,b)-c": {"a": 0.5, "b": 0.5, "c": -1}, "(a-b)-(b-c)": {"a": 1, "b": -2, "c": 1}}
    return R.contrasts(m, of)


def ece_contrasts(s, d):
    m = R.run_metrics(runs(s, d), *BOOT)
    c = R.contrasts(m, {"a-b": {"a": 1, "b": -1}, "c-b": {"c": 1, "b": -1}}, "ece")
    return c.withColumn("level", R.level(F.col("ci_lo"), F.col("ci_hi")))


def seeds(s, d):
    m = M.proper_scores(runs(s, d), ["run"])
    return m.agg(F.avg("nll").alias("mean"), F.min("nll").alias("lowest"), F.max("nll").alias("highest"), F.count("*").alias("n_seeds"))


def cross_split(s, d):
    """The same resample index over two splits: the mean of their accuracies, per draw."""
    j = choice(s, d)
    parts = None
    for split in ("valid", "test"):
        rows = j.where(F.col("split") == split)
        m = R.resampled_metrics(rows, ["split"], PAIRED, f"boot:{split}").where("b >= 0")
        parts = m if parts is None else parts.unionByName(m)
    return parts.groupBy("b").agg(F.avg("accuracy").alias("m")).agg(*R.interval("m", "mean_accuracy"))


def paired_failures(s, d):
    """A run against a baseline whose every fifth reply failed to parse and counts as wrong."""
    b = M.answers(run_c(s, d)).withColumn("hit", F.when(F.col("record_id") % 5 == 0, 0).otherwise(F.col("hit")))
    return R.paired(choice(s, d), b, ["split"], *BOOT)


def accuracy_table(s, d):
    m = M.answers(X.results_choice(s, d)).withColumn("run", F.lit("a")).unionByName(M.answers(run_c(s, d)).withColumn("run", F.lit("c")))
    m = m.groupBy("run", "split").agg(F.avg("hit").alias("accuracy"))
    return m.groupBy("split").pivot("run", ["a", "c"]).agg(F.first("accuracy")).withColumn("delta", F.col("a") - F.col("c"))


def curve(s, d):
    """A curve of accuracy by number of rows seen."""
    j = choice(s, d).withColumn("step", F.floor(F.col("record_id") / 100)).groupBy("split", "step").agg(F.round(F.avg("hit"), 9).alias("value"))
    return R.curve_summary(j, ["split"])


def checked(s, d):
    m = M.proper_scores(choice(s, d), ["split"])
    stored = m.select("split", F.round(F.when(F.col("split") == "test", F.col("accuracy") + 0.01).otherwise(F.col("accuracy")), 12).alias("value"))
    return R.stored_differences(m.select("split", F.round("accuracy", 12).alias("value")), stored, ["split"]).select("split")


def kept_at(s, d):
    j = choice(s, d)
    at = j.withColumn("t", F.explode(F.array(F.lit(0.8), F.lit(0.9), F.lit(0.95)))).groupBy("t")
    kept = F.col("top1") >= F.col("t") - D.SLACK
    return at.agg(F.avg(kept.cast("int")).alias("coverage"), F.avg(F.when(kept, F.col("hit"))).alias("accuracy"))


def forgetting(s, d):
    """Change of accuracy against the first run, by split and run."""
    m = runs(s, d).groupBy("run", "split").agg(F.avg("hit").alias("accuracy"))
    first = m.where("run = 'a'").select("split", F.col("accuracy").alias("base"))
    return m.join(first, "split").select("run", "split", (F.col("accuracy") - F.col("base")).alias("change"))


def grid_table(s, d):
    return K.best(K.losses(X.results(s, d).where("split = 'valid'"), K.nll_loss, ["qtype"], K.grid()), ["qtype"])


def calibrated(s, d):
    """Temperatures over all rows, by split and by type."""
    scopes = F.array(F.lit("all"), F.concat(F.lit("split:"), "split"), F.concat(F.lit("type:"), "qtype"))
    return K.fitted(X.results(s, d).withColumn("scope", scopes), "nll", ["scope"])


def inversion(s, d):
    return M.proper_scores(M.answers(K.inverted(X.results_choice(s, d), 0.2)), ["split"])


def channels(s, d):
    j, f = choice(s, d), 0.2
    forms = {"stored": F.col("top1"), "mapped": f + (1 - 2 * f) * F.col("top1")}
    out = None
    for name, conf in forms.items():
        e = M.ece(K.channel(j, f, conf).withColumn("form", F.lit(name)), ["form"], value="conf", target="target")
        out = e if out is None else out.unionByName(e)
    only = j.withColumns({"form": F.lit("top1 only"), "conf": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("top1") - f) / (1 - 2 * f)))})
    return out.unionByName(M.ece(only, ["form"], value="conf"))


def recomputed(s, d):
    return M.split_metrics(M.answers(K.scaled(X.results_choice(s, d), 2.0)))


def calibration_table(s, d):
    e = M.ece(runs(s, d), ["split", "run"])
    return e.groupBy("split").pivot("run", ["a", "b", "c"]).agg(F.first("ece"))


def env_split(s, d):
    return K.environment_metrics(environment(s, d), ["split"], "g2")


def env_driver(s, d):
    """The environment's metrics for the run as it is, tempered, and for theta itself."""
    raw = X.results_choice(s, d)
    theta = raw.withColumn("probs", K.theta(F.size("probs"), F.col("gold")))
    out = None
    for name, rows in (("raw", raw), ("tempered", K.scaled(raw, 2.0)), ("theta", theta)):
        m = K.environment_metrics(K.environment_rows(M.answers(rows)).withColumn("form", F.lit(name)), ["form"], "g2")
        out = m if out is None else out.unionByName(m)
    return out


QUERIES = {
    "e1_key_mismatches": lambda s, d: R.key_mismatches(X.results_choice(s, d), run_c(s, d).where("record_id % 10 <> 3"), ["record_id", "question_id"]),
    "e2_bootstrap": lambda s, d: rounded(R.intervals(R.multinomial_metrics(choice(s, d), X.results_choice(s, d), ["qtype"], RESAMPLES, "boot"), ["qtype"])),
    "e2_poisson_bootstrap": lambda s, d: rounded(R.intervals(R.resampled_metrics(choice(s, d), ["qtype"], PAIRED, "pois").where("b >= 0"), ["qtype"])),
    "e3_weighted_runs": lambda s, d: rounded(R.run_metrics(runs(s, d), *BOOT)),
    "e4_contrasts": lambda s, d: rounded(contrast_table(s, d)),
    "e5_paired": lambda s, d: rounded(R.paired(choice(s, d), M.answers(run_c(s, d)), ["qtype"], *BOOT)),
    "e6_ece_deltas": lambda s, d: rounded(ece_contrasts(s, d)),
    "e7_seed_aggregate": lambda s, d: rounded(seeds(s, d)),
    "e8_cross_split": lambda s, d: rounded(cross_split(s, d)),
    "e9_paired_failures": lambda s, d: rounded(paired_failures(s, d)),
    "e10_accuracy_table": lambda s, d: rounded(accuracy_table(s, d)),
    "e11_run_comparison": lambda s, d: rounded(R.run_comparison(runs(s, d), *BOOT, "a", ["a", "b", "c", "d"])),
    "e12_kept_at": lambda s, d: rounded(kept_at(s, d)),
    "e12_named_other": lambda s, d: rounded(R.named_other(runs(s, d))),
    "e13_stored_check": checked,
    "e14_forgetting": lambda s, d: rounded(forgetting(s, d)),
    "e15_curve_summary": lambda s, d: rounded(curve(s, d)),
    "e16_seed_points": lambda s, d: rounded(R.seed_points(M.proper_scores(runs(s, d), ["run"]).select(F.when(F.col("run") == "c", "single").otherwise("several").alias("series"), F.col("run").alias("seed"), F.col("nll").alias("value")), ["series"])),
    "f1_tempered": lambda s, d: rounded(X.results_choice(s, d).select("record_id", F.get(D.tempered(F.col("probs"), 2.0), F.col("gold")).alias("p_gold"))),
    "f2_scaled": lambda s, d: rounded(M.symmetry(K.scaled(X.results_noul(s, d), 1.7))),
    "f3_mean_nll": lambda s, d: rounded(K.losses(X.results(s, d), K.nll_loss, ["qtype"], [0.5, 1.0, 2.0])),
    "f4_temperature_grid": lambda s, d: rounded(grid_table(s, d)),
    "f4_fitted": lambda s, d: rounded(K.fitted(X.results_choice(s, d), "nll", ["qtype"])),
    "f5_outcome_temperature": lambda s, d: rounded(K.fitted(log(s, d), "outcome", [])),
    "f6_scoped_temperatures": lambda s, d: rounded(calibrated(s, d)),
    "f7_log_temperature": lambda s, d: rounded(K.fitted(learner_log(s, d), "outcome", [])),
    "f8_inverted": lambda s, d: rounded(inversion(s, d)),
    "f9_channel_ece": lambda s, d: rounded(channels(s, d)),
    "f10_entropy_floor": lambda s, d: rounded(tables(s, d, "lineitem").groupBy(F.col("l_discount").alias("rate")).agg(F.count("*").alias("n")).withColumn("floor", K.binary_entropy(F.col("rate")))),
    "f11_recomputed": lambda s, d: rounded(recomputed(s, d)),
    "f12_calibration_table": lambda s, d: rounded(calibration_table(s, d)),
    "g1_theta": lambda s, d: rounded(choice(s, d).select("record_id", K.eta(F.col("k")).alias("eta"), F.array_max(K.theta(F.col("k"), F.col("gold"))).alias("on_gold"), F.get(K.theta(F.col("k"), F.col("gold")), (F.col("gold") + 1) % F.col("k")).alias("off_gold"))),
    "g2_accepted": lambda s, d: choice(s, d).select("record_id", K.accepted(F.col("k"), F.col("gold"), "g2", F.col("record_id"), F.col("question_id")).cast("int").alias("accepted")),
    "g3_scores": lambda s, d: rounded(environment(s, d).select("record_id", "brier_theta", "brier_min", "ce", "entropy")),
    "g4_question_rows": lambda s, d: rounded(environment(s, d).select("record_id", "k", "hit", "p_gold", "top1", "top1_hit", "one_minus_eta")),
    "g5_by_k": lambda s, d: rounded(K.by_k(environment(s, d))),
    "g5_calibration_gap": lambda s, d: rounded(K.calibration_gap(K.by_k(environment(s, d)))),
    "g6_environment_metrics": lambda s, d: rounded(env_split(s, d)),
    "g7_bandit_samples": lambda s, d: K.bandit_samples(X.results_choice(s, d), 4, 0.1, "g7").select("record_id", "g", "action", "outcome"),
    "g7_bandit_temperature": lambda s, d: rounded(K.fitted(K.bandit_samples(X.results_choice(s, d), 4, 0.1, "g7"), "outcome", [])),
    "g8_oracle_temperature": lambda s, d: rounded(K.fitted(choice(s, d), "theta", ["k"])),
    "g9_environment_forms": lambda s, d: rounded(env_driver(s, d)),
    "h1_behaviour": lambda s, d: rounded(X.results_choice(s, d).select("record_id", F.array_max(D.behaviour(F.col("probs"), 0.1)).alias("most"), F.array_min(D.behaviour(F.col("probs"), 0.1)).alias("least"))),
    "h2_actions": lambda s, d: rounded(log(s, d).select("index", "action", "propensity")),
    "h3_flips": lambda s, d: log(s, d).select("index", "outcome", "flipped"),
    "h4_interactions": lambda s, d: rounded(log(s, d).select("index", "record_id", "question_id", "action", "propensity", "outcome", "flipped", F.size("labels").alias("k"))),
    "h5_reflip": lambda s, d: B.reflip(log(s, d), 0, 0.1).select("index", "flipped"),
    "h6_prefix": lambda s, d: B.prefix(log(s, d), 400).select("index", "part"),
    "h7_log_likelihood": lambda s, d: rounded(B.log_likelihood(B.prefix(log(s, d), 400), ["part"])),
    "h8_log_statistics": lambda s, d: rounded(B.log_statistics(log(s, d))),
    "h9_ips_weights": lambda s, d: rounded(B.ips_weights(B.prefix(log(s, d), 400), ["part"]).select("index", "part", "normaliser", "clipped_share", "weight")),
    "h10_importance": lambda s, d: rounded(log(s, d).groupBy("outcome").agg(F.max(B.p_action() / F.col("propensity")).alias("max_ratio"), F.avg(B.importance_weight(B.p_action(), F.col("propensity"), 1.05)).alias("mean_weight"), F.sum((B.p_action() / F.col("propensity") > 1.05).cast("int")).alias("n_clipped"))),
    "h11_rewards": lambda s, d: rounded(log(s, d).select("index", *[B.reward(a, F.col("outcome"), B.p_action()).alias(f"r_{a}") for a in B.ARMS])),
    "h12_advantages": lambda s, d: rounded(B.advantages(draws(s, d), "brier", True).select("record_id", "g", "action", "reward", "advantage")),
    "h13_arm_losses": lambda s, d: rounded(B.arm_losses(B.ips_weights(B.prefix(log(s, d), 400).where("part = 'train'"), ["part"]))),
    "h14_soft_target": lambda s, d: rounded(log(s, d).select("index", B.soft_target(F.col("outcome"), 0.2).alias("target"))),
    "h15_simulation": lambda s, d: rounded(simulated(s, d)),
    "h16_expected_step": lambda s, d: rounded(X.results_choice(s, d).select("record_id", *[B.expected_gold_step(F.col("probs"), F.col("gold"), a, 4).alias(a) for a in B.ARMS])),
    "h16_enumeration": enumerated,
    "l_sign_check": lambda s, d: rounded(sign_checks(s, d)),
    "h17_log_mismatches": lambda s, d: B.log_mismatches(log(s, d), X.results_choice(s, d).where("record_id % 10 <> 4").withColumn("labels", F.when(F.col("record_id") % 10 == 5, F.reverse("labels")).otherwise(F.col("labels")))),
    "h17_log_steps": lambda s, d: B.prefix(log(s, d), 400).groupBy("part").agg(B.log_steps(F.count("*"), 3, 40, 16).alias("steps")),
    "h18_validation": lambda s, d: rounded(B.validation(X.results_choice(s, d), run_b(s, d), "brier")),
}

# --- SQL ---------------------------------------------------------------------------------------------

_T = "list_transform(range(61), lambda i: 0.05 * pow(400.0, i / 60.0))"


def tempered(p: str, t: str) -> str:
    return sql_softmax(f"list_transform({p}, lambda x: ln(greatest(x, 1e-45)) / {t})")


def sql_best(rows: str, by: str, loss: str) -> str:
    """Grid search: ``rows`` with a loss expression over t."""
    keys = f"{by}, " if by else ""
    return f"""
    SELECT {keys}t AS temperature, l AS loss, n FROM (SELECT *, row_number() OVER ({f'PARTITION BY {by}' if by else ''} ORDER BY l, t) AS i FROM (
      SELECT {keys}t, round(avg({loss}), 12) AS l, count(*) AS n FROM ({rows}), (SELECT unnest({_T}) AS t) GROUP BY {keys}t)) WHERE i = 1"""


def sql_zoomed(rows: str, by: str, loss: str) -> str:
    """The grid, a finer grid about its best point, and the vertex of a parabola by finite differences."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON true"
    step = "(ln(400.0) / 60 / 20)"
    return f"""
    SELECT {keys}t * exp(CASE WHEN lower IS NULL OR upper IS NULL OR lower - 2 * mean + upper <= 0 THEN 0.0 ELSE (lower - upper) / (2 * (lower - 2 * mean + upper)) END * {step}) AS fit FROM (
      SELECT *, row_number() OVER ({part} ORDER BY l, t) AS i FROM (
        SELECT *, round(mean, 12) AS l, lag(mean) OVER ({part} ORDER BY t) AS lower, lead(mean) OVER ({part} ORDER BY t) AS upper FROM (
          SELECT {keys}t, avg({loss}) AS mean, count(*) AS n FROM (
            SELECT x.*, c.temperature * exp(j * {step}) AS t FROM ({rows}) x JOIN ({sql_best(rows, by, loss)}) c {using}, (SELECT unnest(range(-20, 21)) AS j)
          ) WHERE t BETWEEN 0.05 * (1 - 1e-9) AND 20 * (1 + 1e-9) GROUP BY {keys}t))) WHERE i = 1"""


def sql_fitted(rows: str, by: str, loss: str, score: str, outcome: str | None = None) -> str:
    """From there three steps of Newton's method, with derivatives of the mean loss by the temperature's logarithm."""
    keys = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    a = "(m - s)" if outcome is None else f"((1 - {outcome}) * p / (1 - p) * (s - m) - {outcome} * (s - m))"
    b = "v" if outcome is None else f"({outcome} * v + (1 - {outcome}) * p / (1 - p) * ((s - m) * (s - m) / (1 - p) - v))"
    inside = "true" if outcome is None else "p BETWEEN 1e-6 AND 1 - 1e-6"
    fit = sql_zoomed(rows, by, loss)
    for _ in range(3):
        fit = f"""
        SELECT {keys}CASE WHEN avg(d2) > 0 AND any_value(t) BETWEEN 0.0500001 AND 19.99999 THEN least(greatest(any_value(t) * exp(-avg(d1) / avg(d2)), 0.05), 20.0) ELSE any_value(t) END AS fit FROM (
          SELECT *, CASE WHEN {inside} THEN -{a} / t ELSE 0 END AS d1, CASE WHEN {inside} THEN {b} / t / t + {a} / t ELSE 0 END AS d2 FROM (
            SELECT *, exp((s - list_max(lp)) / t) / w0 AS p, w1 / w0 AS m, w2 / w0 - pow(w1 / w0, 2) AS v FROM (
              SELECT *, list_sum(w) AS w0, list_sum(list_transform(range(1, len(w) + 1), lambda i: w[i] * lp[i])) AS w1, list_sum(list_transform(range(1, len(w) + 1), lambda i: w[i] * lp[i] * lp[i])) AS w2 FROM (
                SELECT x.*, fit AS t, {score} AS s, list_transform(lp, lambda y: exp((y - list_max(lp)) / fit)) AS w FROM ({rows}) x JOIN ({fit}) c {using})))) {group}"""
    return f"SELECT {keys}any_value(t) AS temperature, round(avg({loss}), 12) AS loss, count(*) AS n FROM (SELECT x.*, fit AS t FROM ({rows}) x JOIN ({fit}) c {using}) {group}"


_LSE = "(list_max(z) + ln(list_sum(list_transform(z, lambda y: exp(y - list_max(z))))))"
_NLL = "ln(list_sum(list_transform(lp, lambda y: exp((y - list_max(lp)) / t)))) + (list_max(lp) - lp[gold + 1]) / t"
_LP = "list_transform(probs, lambda x: ln(greatest(x, 1e-45))) AS lp"
_PT = "exp((lp[action + 1] - list_max(lp)) / t) / list_sum(list_transform(lp, lambda y: exp((y - list_max(lp)) / t)))"
_BLL = "-({o} * ln(least(greatest({p}, 1e-6), 1 - 1e-6)) + (1 - {o}) * ln(1 - least(greatest({p}, 1e-6), 1 - 1e-6)))"
_OUT = _BLL.format(o="outcome", p=f"({_PT})")
_ETA = "least(0.40, 0.05 + 0.03 * ({k} - 2))"
_THETA = f"list_transform(range({{k}}), lambda i: CASE WHEN i = gold THEN 1 - {_ETA} ELSE {_ETA} / ({{k}} - 1) END)"
TH = _THETA.format(k="k")
ET = _ETA.format(k="k")
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


def sql_accepted(stream: str) -> str:
    which = f"CAST(floor({sql_uniform(f'{stream}:which', 'record_id', 'question_id')} * (k - 1)) AS INT)"
    return f"CASE WHEN {sql_uniform(f'{stream}:noise', 'record_id', 'question_id')} < 1 - {ET} THEN gold ELSE {which} + CAST({which} >= gold AS INT) END"


def sql_env(of: str) -> str:
    return f"""
    SELECT *, {_DOT.format(a='p', b='p')} - 2 * {_DOT.format(a='p', b='theta')} + 1 AS brier_theta, 1 - {_DOT.format(a='theta', b='theta')} AS brier_min,
      -list_sum(list_transform(range(1, k + 1), lambda i: theta[i] * ln(greatest(p[i], 1e-12)))) AS ce, -list_sum(list_transform(theta, lambda x: x * ln(greatest(x, 1e-12)))) AS entropy,
      p[gold + 1] AS p_gold, list_max(p) AS top, theta[prediction + 1] AS top1_hit, 1 - {ET} AS one_minus_eta
    FROM (SELECT *, list_transform(probs, lambda x: x / list_sum(probs)) AS p, {TH} AS theta FROM {of})"""


def sql_env_metrics(by: str, of: str, accepted: str) -> str:
    return f"""
    SELECT m.*, calibration_gap, sampled_ece FROM (SELECT {by}, count(*) AS n, avg(hit) AS accuracy, avg(brier_theta) AS expected_brier, avg(brier_min) AS brier_min, avg(ce) AS cross_entropy, avg(entropy) AS entropy, avg(ce - entropy) AS kl FROM {of} GROUP BY {by}) m
    JOIN (SELECT {by}, sum(c * abs(g)) / sum(c) AS calibration_gap FROM (SELECT {by}, k, count(*) AS c, avg(top) - avg(top1_hit) AS g FROM {of} GROUP BY {by}, k) GROUP BY {by}) USING ({by})
    JOIN (SELECT {by}, sum(abs(h - c)) / sum(n) AS sampled_ece FROM (SELECT {by}, least(CAST(floor(top * 15) AS INT), 14) AS bin, count(*) AS n, sum(CAST(prediction = {accepted} AS INT)) AS h, sum(top) AS c FROM {of} GROUP BY ALL) GROUP BY {by}) USING ({by})"""


def sql_judged(of: str) -> str:
    return f"SELECT *, CAST(prediction = gold AS INT) AS hit FROM (SELECT *, len(probs) AS k, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS prediction, list_max(probs) AS top1 FROM {of})"


def sql_weights(resamples: int, seed: str, of: str) -> str:
    return f"""
    SELECT b, record_id, count(*) AS w FROM (SELECT b, CAST(floor({sql_uniform(seed, 'b', 'j')} * n) AS BIGINT) + 1 AS i
      FROM (SELECT unnest(range({resamples})) AS b), (SELECT row_number() OVER () AS j, count(*) OVER () AS n FROM (SELECT DISTINCT record_id FROM {of})))
    JOIN (SELECT record_id, row_number() OVER (ORDER BY md5('{seed}:index:' || record_id)) AS i FROM (SELECT DISTINCT record_id FROM {of})) USING (i) GROUP BY ALL"""


def sql_resampled(by: str, of: str, w: str) -> str:
    return f"SELECT {by}, b, sum(h) / sum(n) AS accuracy, sum(abs(h - c)) / sum(n) AS ece FROM (SELECT {by}, b, least(CAST(floor(top1 * 15) AS INT), 14) AS bin, sum(w) AS n, sum(w * hit) AS h, sum(w * top1) AS c FROM {of} JOIN {w} USING (record_id) GROUP BY ALL) GROUP BY ALL"


def ci(x: str, name: str) -> str:
    return f"quantile_cont({x}, 0.025) AS {name}_lo, quantile_cont({x}, 0.975) AS {name}_hi"


def sql_paired(by: str, a: str, b: str) -> str:
    return f"""
    SELECT p.*, delta_lo, delta_hi FROM (SELECT a.{by}, count(*) AS n, avg(a.hit) AS accuracy_a, avg(b.hit) AS accuracy_b, avg(a.hit - b.hit) AS delta, avg(CAST(a.prediction <> b.prediction AS INT)) AS disagreement FROM {a} a JOIN {b} b USING (record_id, question_id) GROUP BY 1) p
    JOIN (SELECT {by}, {ci('d', 'delta')} FROM (SELECT a.{by}, w.b, sum(w * (a.hit - b.hit)) / sum(w) AS d FROM {a} a JOIN {b} b USING (record_id, question_id) JOIN weights w USING (record_id) GROUP BY 1, 2) GROUP BY {by}) USING ({by})"""


_RW = {
    "outcome": "CAST({r} AS DOUBLE)", "outcome_minus_p": "({r} - {p})", "brier": "(1 - pow({r} - {p}, 2))",
    "log": "({r} * ln(least(greatest({p}, 1e-6), 1 - 1e-6)) + (1 - {r}) * ln(1 - least(greatest({p}, 1e-6), 1 - 1e-6)))",
}


def sql_simulate(arm: str) -> str:
    return f"""
    SELECT '{arm}' AS arm, count(*) AS questions, CAST(sum(n_gold) AS BIGINT) AS gold_samples, CAST(sum(size - n_gold) AS BIGINT) AS wrong_samples, sum(gn) / sum(n_gold) AS gold_negative_advantage, sum(wp) / sum(size - n_gold) AS wrong_positive_advantage,
      avg(CAST(step < -1e-9 AS INT)) AS gold_logit_down, avg(CAST(step > 1e-9 AS INT)) AS gold_logit_up, avg(step) AS mean_gold_logit_step, avg(CAST(abs(step) <= 1e-9 AND a0 = a1 AS INT)) AS zero_identical,
      avg(CAST(abs(step) <= 1e-9 AND a0 <> a1 AND widest < 1e-9 AS INT)) AS zero_equal_rewards, avg(CAST(abs(step) <= 1e-9 AND widest >= 1e-9 AS INT)) AS zero_other,
      CAST(sum(CAST(n_gold > 0 AND n_gold < size AS INT)) AS BIGINT) AS mixed_groups, avg(CAST(ga < -1e-9 AS INT)) FILTER (WHERE n_gold > 0 AND n_gold < size) AS mixed_gold_negative
    FROM (SELECT record_id, avg(adv * least(p / q, 5.0) * (r - p_gold)) AS step, sum(r) AS n_gold, count(*) AS size, sum(CAST(r = 1 AND adv < -1e-9 AS INT)) AS gn, sum(CAST(r = 0 AND adv > 1e-9 AS INT)) AS wp, min(action) AS a0, max(action) AS a1, max(abs(adv)) AS widest, avg(adv) FILTER (WHERE r = 1) AS ga
      FROM (SELECT *, {_RW[arm].format(r='r', p='p')} - avg({_RW[arm].format(r='r', p='p')}) OVER (PARTITION BY record_id) AS adv FROM draws) GROUP BY record_id)"""


def sql_gradients(arm: str) -> str:
    reward = _RW[arm].format(r="r", p="p")
    return f"""
    SELECT '{arm}' AS arm, count(*) AS questions, count(*) FILTER (WHERE at_gold > 1e-9) AS gold_lowered, count(*) FILTER (WHERE at_gold < -1e-9) AS gold_raised, avg(loss) AS mean_loss, avg(size) AS mean_gradient, true AS matches, max(abs(total)) < 1e-6 AS sums_to_zero
    FROM (SELECT record_id, sum(loss) / max(k) AS loss, sum(abs(slope)) AS size, sum(slope) AS total, max(slope) FILTER (WHERE j = gold) AS at_gold
      FROM (SELECT d.record_id, j, max(d.gold) AS gold, max(d.k) AS k, -avg(aw * ln(greatest(p, 1e-45))) AS loss, -avg(aw * (CAST(action = j AS INT) - probs[j + 1] / list_sum(probs))) AS slope
        FROM (SELECT *, (reward - avg(reward) OVER (PARTITION BY record_id)) * least(p / q, 5.0) AS aw FROM (SELECT *, {reward} AS reward FROM draws)) d
        JOIN (SELECT record_id, probs, unnest(range(len(probs))) AS j FROM results_choice) o USING (record_id) GROUP BY d.record_id, j) GROUP BY record_id)"""


def sql_draws(seed: str) -> str:
    return f"""
    SELECT record_id, question_id, gold, k, g, action, p[action + 1] AS p, q[action + 1] AS q, p[gold + 1] AS p_gold, CAST(action = gold AS INT) AS r FROM (
      SELECT *, CAST(coalesce(list_position(list_transform(range(1, k + 1), lambda i: u < list_sum(q[1:i])), true), k) - 1 AS INT) AS action FROM (
        SELECT *, list_transform(p, lambda x: 0.9 * x / list_sum(p) + 0.1 / k) AS q, {sql_uniform(seed, 'record_id', 'question_id', 'g')} AS u FROM (
          SELECT *, len(probs) AS k, list_transform(probs, lambda x: x / list_sum(probs)) AS p FROM results_choice, (SELECT unnest(range(1, 5)) AS g))))"""


_STEP = "0.75 * probs[gold + 1] * (rw[gold + 1] - list_sum(list_transform(range(1, len(probs) + 1), lambda i: probs[i] * rw[i])))"
_GRID_LOG = f"(SELECT *, {_LP} FROM log)"
_FX = _RUNS | {
    "log": f"""
    SELECT i AS "index", record_id, question_id, labels, probs, action, q[action + 1] AS propensity, CAST(action = gold AS INT) AS outcome,
      CASE WHEN {sql_uniform('v3_flip:0', 'i')} < 0.2 THEN 1 - CAST(action = gold AS INT) ELSE CAST(action = gold AS INT) END AS flipped FROM (
      SELECT *, CAST(coalesce(list_position(list_transform(range(1, len(q) + 1), lambda j: u < list_sum(q[1:j])), true), len(q)) - 1 AS INT) AS action FROM (
        SELECT *, list_transform(probs, lambda x: 0.9 * x / list_sum(probs) + 0.1 / len(probs)) AS q, {sql_uniform('v3_log:0', 'i')} AS u FROM (
          SELECT *, row_number() OVER (ORDER BY md5('v3_log_order:0:' || record_id)) - 1 AS i FROM results_choice)))""",
    "prefixed": "SELECT *, CASE WHEN \"index\" < 360 THEN 'train' ELSE 'select' END AS part FROM log WHERE \"index\" < 400",
    "weighted": "SELECT *, least(1 / propensity, 5.0) / avg(least(1 / propensity, 5.0)) OVER (PARTITION BY part) AS weight, avg(least(1 / propensity, 5.0)) OVER (PARTITION BY part) AS normaliser, avg(CAST(1 / propensity > 5 AS INT)) OVER (PARTITION BY part) AS clipped_share FROM prefixed",
    "weights": sql_slots(PAIRED, "boot", "results_choice"),
    "many_weights": sql_weights(RESAMPLES, "boot", "results_choice"),
    "run_table": sql_resampled("run", "all_runs", "(SELECT b, record_id, w FROM weights UNION ALL SELECT -1, record_id, 1 FROM results_choice)"),
    "draws": sql_draws("h15"),
    "bandit": f"SELECT d.record_id, d.g, d.action, CAST(d.action = {sql_accepted('g7:env')} AS INT) AS outcome FROM ({sql_draws('g7')}) d",
    "environment": sql_env("judged_choice"),
}


def q(body: str) -> str:
    return oracle(body, **_FX)


def rr(body: str, keys: str, values: str, **more: str) -> str:
    return r(body, keys, values, **_FX, **more)


_CONTRASTS = {"a-c": "a - c", "mean(a,b)-c": "0.5 * a + 0.5 * b - c", "(a-b)-(b-c)": "a - 2 * b + c"}


def sql_contrasts(of: dict[str, str], value: str) -> str:
    wide = f"(SELECT b AS draw, max({value}) FILTER (WHERE run = 'a') AS a, max({value}) FILTER (WHERE run = 'b') AS b, max({value}) FILTER (WHERE run = 'c') AS c FROM run_table GROUP BY run_table.b)"
    return " UNION ALL ".join(f"SELECT '{n}' AS contrast, max({e}) FILTER (WHERE draw < 0) AS value, quantile_cont({e}, 0.025) FILTER (WHERE draw >= 0) AS ci_lo, quantile_cont({e}, 0.975) FILTER (WHERE draw >= 0) AS ci_hi FROM {wide}" for n, e in of.items())


_STAT = "list_max(list_transform(range(1, len(probs) + 1), lambda i: CASE WHEN i = action + 1 THEN abs(0.9 * probs[i] / list_sum(probs) + 0.1 / len(probs) - propensity) ELSE 0 END))"
_TOP = "action = list_position(probs, list_max(probs)) - 1"
ORACLES = {
    "e1_key_mismatches": q("SELECT record_id, question_id, CAST(1 AS BIGINT) AS n_a, CAST(0 AS BIGINT) AS n_b FROM results_choice WHERE record_id % 10 = 3"),
    "e2_bootstrap": rr(f"SELECT qtype, {ci('accuracy', 'accuracy')}, {ci('ece', 'ece')} FROM ({sql_resampled('qtype', 'judged_choice', 'many_weights')}) GROUP BY qtype", "qtype", "accuracy_lo accuracy_hi ece_lo ece_hi"),
    "e2_poisson_bootstrap": rr(
        f"SELECT qtype, {ci('accuracy', 'accuracy')}, {ci('ece', 'ece')} FROM ({sql_resampled('qtype', 'judged_choice', 'pois')}) GROUP BY qtype", "qtype", "accuracy_lo accuracy_hi ece_lo ece_hi",
        pois=sql_slots(PAIRED, "pois", "results_choice"),
    ),
    "e3_weighted_runs": rr("SELECT run, CAST(b AS INT) AS b, accuracy, ece FROM run_table", "run b", "accuracy ece"),
    "e4_contrasts": rr(sql_contrasts(_CONTRASTS, "accuracy"), "contrast", "value ci_lo ci_hi"),
    "e5_paired": rr(sql_paired("qtype", "judged_choice", "judged_c"), "qtype n", "accuracy_a accuracy_b delta disagreement delta_lo delta_hi"),
    "e6_ece_deltas": rr(f"SELECT *, CASE WHEN ci_lo > 0 THEN 'above' WHEN ci_hi < 0 THEN 'below' ELSE 'level' END AS level FROM ({sql_contrasts({'a-b': 'a - b', 'c-b': 'c - b'}, 'ece')})", "contrast level", "value ci_lo ci_hi"),
    "e7_seed_aggregate": rr(f"SELECT avg(nll) AS mean, min(nll) AS lowest, max(nll) AS highest, count(*) AS n_seeds FROM ({_PROPER.format(by='run', of='all_runs')})", "n_seeds", "mean lowest highest"),
    "e8_cross_split": rr(
        f"SELECT {ci('m', 'mean_accuracy')} FROM (SELECT b, avg(accuracy) AS m FROM ({sql_resampled('split', 'vrows', 'vw')} UNION ALL {sql_resampled('split', 'trows', 'tw')}) GROUP BY b)", "", "mean_accuracy_lo mean_accuracy_hi",
        vrows="SELECT * FROM judged_choice WHERE split = 'valid'", trows="SELECT * FROM judged_choice WHERE split = 'test'", vw=sql_slots(PAIRED, "boot:valid", "vrows"), tw=sql_slots(PAIRED, "boot:test", "trows"),
    ),
    "e9_paired_failures": rr(sql_paired("split", "judged_choice", "failing"), "split n", "accuracy_a accuracy_b delta disagreement delta_lo delta_hi", failing="SELECT * REPLACE (CASE WHEN record_id % 5 = 0 THEN 0 ELSE hit END AS hit) FROM judged_c"),
    "e10_accuracy_table": rr("SELECT split, avg(hit) FILTER (WHERE run = 'a') AS a, avg(hit) FILTER (WHERE run = 'c') AS c, avg(hit) FILTER (WHERE run = 'a') - avg(hit) FILTER (WHERE run = 'c') AS delta FROM all_runs GROUP BY split", "split", "a c delta"),
    "e11_run_comparison": rr(
        f"SELECT n.run, accuracy, ece, delta, delta_lo, delta_hi, accuracy IS NULL AS missing FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS run) n LEFT JOIN (SELECT run, max(accuracy) FILTER (WHERE b < 0) AS accuracy, max(ece) FILTER (WHERE b < 0) AS ece, max(d) FILTER (WHERE b < 0) AS delta, quantile_cont(d, 0.025) FILTER (WHERE b >= 0) AS delta_lo, quantile_cont(d, 0.975) FILTER (WHERE b >= 0) AS delta_hi FROM (SELECT t.*, t.accuracy - o.accuracy AS d FROM run_table t JOIN (SELECT b, accuracy FROM run_table WHERE run = 'a') o USING (b)) GROUP BY run) g USING (run)",
        "run missing", "accuracy ece delta delta_lo delta_hi",
    ),
    "e12_kept_at": rr("SELECT t, avg(CAST(top1 >= t - 1e-12 AS INT)) AS coverage, avg(hit) FILTER (WHERE top1 >= t - 1e-12) AS accuracy FROM judged_choice, (SELECT unnest([0.8, 0.9, 0.95]) AS t) GROUP BY t", "", "t coverage accuracy"),
    "e12_named_other": rr("SELECT run, avg(said) AS predicted_other_rate, CAST(sum(CAST(anyone = 0 AS INT)) AS BIGINT) AS n_named, avg(hit) FILTER (WHERE anyone = 0) AS accuracy_named FROM (SELECT *, max(said) OVER (PARTITION BY record_id, question_id) AS anyone FROM (SELECT *, CAST(labels[prediction + 1] = 'other' AS INT) AS said FROM all_runs)) GROUP BY run", "run n_named", "predicted_other_rate accuracy_named"),
    "e13_stored_check": q("SELECT DISTINCT split FROM judged_choice WHERE split = 'test'"),
    "e14_forgetting": rr("SELECT run, split, accuracy - max(accuracy) FILTER (WHERE run = 'a') OVER (PARTITION BY split) AS change FROM (SELECT run, split, avg(hit) AS accuracy FROM all_runs GROUP BY ALL)", "run split", "change"),
    "e15_curve_summary": rr(
        "SELECT split, min(step) AS first_step, arg_min(value, step) AS first_value, arg_min(step, step) FILTER (WHERE value = best) AS best_step, max(value) AS best_value, max(step) AS last_step, arg_max(value, step) AS last_value FROM (SELECT *, max(value) OVER (PARTITION BY split) AS best FROM (SELECT split, CAST(record_id // 100 AS BIGINT) AS step, round(avg(hit), 9) AS value FROM judged_choice GROUP BY ALL)) GROUP BY split",
        "split first_step best_step last_step", "first_value best_value last_value",
    ),
    "e16_seed_points": rr(f"SELECT series, avg(nll) AS value, CASE WHEN count(*) > 1 THEN min(nll) END AS lowest, CASE WHEN count(*) > 1 THEN max(nll) END AS highest, count(*) AS n_seeds FROM (SELECT CASE WHEN run = 'c' THEN 'single' ELSE 'several' END AS series, nll FROM ({_PROPER.format(by='run', of='all_runs')})) GROUP BY series", "series n_seeds", "value lowest highest"),
    "f1_tempered": rr(f"SELECT record_id, ({tempered('probs', '2.0')})[gold + 1] AS p_gold FROM results_choice", "record_id", "p_gold"),
    "f2_scaled": rr(
        "SELECT coalesce(kind, 'overall') AS kind, count(*) AS n, avg(a + b) AS mean_sum, stddev_pop(a + b) AS std_sum, avg(CAST((a >= 0.5) <> (b >= 0.5) AS INT)) AS argmax_consistent FROM "
        f"(SELECT kind, ({tempered('probs', '1.7')})[1] AS a, ({tempered('[negated_p_yes, 1 - negated_p_yes]', '1.7')})[1] AS b FROM results_noul) t GROUP BY GROUPING SETS ((t.kind), ())",
        "kind n", "mean_sum std_sum argmax_consistent",
    ),
    "f3_mean_nll": rr(f"SELECT qtype, CAST(t AS DOUBLE) AS t, avg({_NLL}) AS loss, count(*) AS n FROM (SELECT *, {_LP} FROM results), (SELECT unnest([0.5, 1.0, 2.0]) AS t) GROUP BY ALL", "qtype n", "t loss"),
    "f4_temperature_grid": rr(sql_best(f"SELECT *, {_LP} FROM results WHERE split = 'valid'", "qtype", _NLL), "qtype n", "temperature loss"),
    "f4_fitted": rr(sql_fitted(f"SELECT *, {_LP} FROM results_choice", "qtype", _NLL, "lp[gold + 1]"), "qtype n", "temperature loss"),
    "f5_outcome_temperature": rr(sql_fitted(_GRID_LOG, "", _OUT, "lp[action + 1]", "outcome"), "n", "temperature loss"),
    "f6_scoped_temperatures": rr(sql_fitted(f"SELECT *, {_LP}, unnest(['all', 'split:' || split, 'type:' || qtype]) AS scope FROM results", "scope", _NLL, "lp[gold + 1]"), "scope n", "temperature loss"),
    "f7_log_temperature": rr(sql_fitted("SELECT l.*, list_transform(b.probs, lambda x: ln(greatest(x, 1e-45))) AS lp FROM prefixed l JOIN run_b b ON l.record_id = b.record_id AND l.labels = b.labels WHERE part = 'train'", "", _OUT, "lp[action + 1]", "outcome"), "n", "temperature loss"),
    "f8_inverted": rr(
        _PROPER.format(by="split", of="turned"), "split n", "accuracy brier nll",
        turned=f"SELECT *, CAST(prediction = gold AS INT) AS hit FROM (SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS prediction FROM (SELECT record_id, split, gold, CASE WHEN list_sum(c) > 0 THEN list_transform(c, lambda x: x / list_sum(c)) ELSE probs END AS probs FROM (SELECT *, list_transform(probs, lambda x: greatest(0.0, least(1.0, (x - 0.2) / (1 - 2 * 0.2)))) AS c FROM results_choice)))",
    ),
    "f9_channel_ece": rr(
        "SELECT form, sum(abs(h - c)) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM (SELECT form, least(CAST(floor(conf * 15) AS INT), 14) AS bin, count(*) AS n, sum(target) AS h, sum(conf) AS c FROM forms GROUP BY ALL) GROUP BY form", "form n", "ece",
        forms="SELECT 'stored' AS form, CAST(top1 AS DOUBLE) AS conf, CAST(0.2 + (1 - 2 * 0.2) * hit AS DOUBLE) AS target FROM judged_choice UNION ALL SELECT 'mapped', 0.2 + (1 - 2 * 0.2) * top1, 0.2 + (1 - 2 * 0.2) * hit FROM judged_choice UNION ALL SELECT 'top1 only', greatest(0.0, least(1.0, (top1 - 0.2) / (1 - 2 * 0.2))), hit FROM judged_choice",
    ),
    "f10_entropy_floor": r("SELECT l_discount AS rate, count(*) AS n, CASE WHEN l_discount IN (0, 1) THEN 0.0 ELSE -(l_discount * ln(l_discount) + (1 - l_discount) * ln(1 - l_discount)) END AS floor FROM lineitem GROUP BY l_discount", "n", "rate floor"),
    "f11_recomputed": rr(
        f"SELECT p.*, ece FROM ({_PROPER.format(by='split, block, name', of='blocks')}) p JOIN ({ece_sql('split, block, name', 'blocks')}) e USING (split, block, name)", "split block name n", "accuracy brier nll ece",
        warm=f"SELECT * REPLACE ({tempered('probs', '2.0')} AS probs) FROM results_choice", warm_judged=sql_judged("warm"),
        blocks="SELECT *, 'overall' AS block, 'all' AS name FROM warm_judged UNION ALL SELECT *, 'type', qtype FROM warm_judged UNION ALL SELECT *, 'kind', qtype || '/' || kind FROM warm_judged UNION ALL SELECT *, 'place', qtype || '/first' FROM warm_judged",
    ),
    "f12_calibration_table": rr(f"SELECT split, max(ece) FILTER (WHERE run = 'a') AS a, max(ece) FILTER (WHERE run = 'b') AS b, max(ece) FILTER (WHERE run = 'c') AS c FROM ({ece_sql('split, run', 'all_runs')}) GROUP BY split", "split", "a b c"),
    "g1_theta": rr(f"SELECT record_id, {ET} AS eta, list_max({TH}) AS on_gold, ({TH})[(gold + 1) % k + 1] AS off_gold FROM judged_choice", "record_id", "eta on_gold off_gold"),
    "g2_accepted": q(f"SELECT record_id, CAST({sql_accepted('g2')} AS INT) AS accepted FROM judged_choice"),
    "g3_scores": rr("SELECT * FROM environment", "record_id", "brier_theta brier_min ce entropy"),
    "g4_question_rows": rr("SELECT * REPLACE (CAST(k AS INT) AS k, top AS top1) FROM environment", "record_id k hit", "p_gold top1 top1_hit one_minus_eta"),
    "g5_by_k": rr("SELECT CAST(k AS INT) AS k, count(*) AS count, avg(top) AS mean_top1, avg(p_gold) AS mean_p_gold, avg(one_minus_eta) AS one_minus_eta, avg(top1_hit) AS expected_top1_hit, avg(top) - avg(top1_hit) AS gap, avg(p_gold) - avg(one_minus_eta) AS gap_gold FROM environment GROUP BY k", "k count", "mean_top1 mean_p_gold one_minus_eta expected_top1_hit gap gap_gold"),
    "g5_calibration_gap": rr("SELECT sum(c * abs(g)) / sum(c) AS calibration_gap FROM (SELECT k, count(*) AS c, avg(top) - avg(top1_hit) AS g FROM environment GROUP BY k)", "", "calibration_gap"),
    "g6_environment_metrics": rr(sql_env_metrics("split", "environment", sql_accepted("g2")), "split n", "accuracy expected_brier brier_min cross_entropy entropy kl calibration_gap sampled_ece"),
    "g7_bandit_samples": q("SELECT record_id, CAST(g AS INT) AS g, action, outcome FROM bandit"),
    "g7_bandit_temperature": rr(sql_fitted(f"SELECT b.*, {_LP} FROM bandit b JOIN results_choice USING (record_id)", "", _OUT, "lp[action + 1]", "outcome"), "n", "temperature loss"),
    "g8_oracle_temperature": rr(sql_fitted(f"SELECT * REPLACE (CAST(k AS INT) AS k), {TH} AS theta, {_LP} FROM judged_choice", "k", "ln(list_sum(list_transform(lp, lambda y: exp((y - list_max(lp)) / t)))) + list_max(lp) / t - list_sum(list_transform(range(1, k + 1), lambda i: theta[i] * lp[i])) / t", "list_sum(list_transform(range(1, k + 1), lambda i: theta[i] * lp[i]))"), "k n", "temperature loss"),
    "g9_environment_forms": rr(
        sql_env_metrics("form", "three", sql_accepted("g2")), "form n", "accuracy expected_brier brier_min cross_entropy entropy kl calibration_gap sampled_ece",
        forms3=f"SELECT 'raw' AS form, record_id, question_id, gold, probs FROM results_choice UNION ALL SELECT 'tempered', record_id, question_id, gold, {tempered('probs', '2.0')} FROM results_choice UNION ALL SELECT 'theta', record_id, question_id, gold, {_THETA.format(k='len(probs)')} FROM results_choice",
        forms3_judged=sql_judged("forms3"), three=sql_env("forms3_judged"),
    ),
    "h1_behaviour": rr("SELECT record_id, list_max(q) AS most, list_min(q) AS least FROM (SELECT record_id, list_transform(probs, lambda x: 0.9 * x / list_sum(probs) + 0.1 / len(probs)) AS q FROM results_choice)", "record_id", "most least"),
    "h2_actions": rr("SELECT * FROM log", '"index" action', "propensity"),
    "h3_flips": q('SELECT "index", outcome, flipped FROM log'),
    "h4_interactions": rr("SELECT *, CAST(len(labels) AS INT) AS k FROM log", '"index" record_id question_id action outcome flipped k', "propensity"),
    "h5_reflip": q(f'SELECT "index", CASE WHEN {sql_uniform("v3_flip:0", chr(34) + "index" + chr(34))} < 0.1 THEN 1 - outcome ELSE outcome END AS flipped FROM log'),
    "h6_prefix": q('SELECT "index", part FROM prefixed'),
    "h7_log_likelihood": rr(f"SELECT part, count(*) AS n, -avg({_BLL.format(o='outcome', p='probs[action + 1]')}) AS log_likelihood FROM prefixed GROUP BY part", "part n", "log_likelihood"),
    "h8_log_statistics": rr(
        f"SELECT count(*) AS n, count(*) FILTER (WHERE outcome = 0) AS negatives, count(*) FILTER (WHERE outcome = 0 AND {_TOP}) AS on_top, count(*) FILTER (WHERE outcome = 0 AND NOT ({_TOP})) AS on_other, sum(0.1 / len(probs) / propensity) FILTER (WHERE outcome = 0 AND NOT ({_TOP})) / count(*) FILTER (WHERE outcome = 0 AND NOT ({_TOP})) AS on_other_uniform_share, "
        f"count(*) FILTER (WHERE outcome = 0 AND labels[action + 1] = 'other') AS chosen_other, max({_STAT}) AS propensity_max_abs_diff, avg(outcome) AS outcome_rate, avg(CAST(flipped <> outcome AS INT)) AS flip_share, avg(propensity) AS mean_propensity FROM log",
        "n negatives on_top on_other chosen_other", "on_other_uniform_share propensity_max_abs_diff outcome_rate flip_share mean_propensity",
    ),
    "h9_ips_weights": rr("SELECT * FROM weighted", '"index" part', "normaliser clipped_share weight"),
    "h10_importance": rr("SELECT outcome, max(probs[action + 1] / propensity) AS max_ratio, avg(least(probs[action + 1] / propensity, 1.05)) AS mean_weight, count(*) FILTER (WHERE probs[action + 1] / propensity > 1.05) AS n_clipped FROM log GROUP BY outcome", "outcome n_clipped", "max_ratio mean_weight"),
    "h11_rewards": rr("SELECT \"index\", " + ", ".join(f"{e.format(r='outcome', p='probs[action + 1]')} AS r_{a}" for a, e in _RW.items()) + " FROM log", '"index"', " ".join(f"r_{a}" for a in _RW)),
    "h12_advantages": rr(f"SELECT record_id, CAST(g AS INT) AS g, action, reward, (reward - avg(reward) OVER (PARTITION BY record_id)) / (stddev_pop(reward) OVER (PARTITION BY record_id) + 1e-6) AS advantage FROM (SELECT *, {_RW['brier'].format(r='r', p='p')} AS reward FROM draws)", "record_id g action", "reward advantage"),
    "h13_arm_losses": rr(
        "SELECT avg(-ln(pa)) FILTER (WHERE outcome = 1) AS positive_sft, avg(-ln(pa) * weight) FILTER (WHERE outcome = 1) AS ips_positive, avg(pow(outcome - pa, 2)) AS direct_brier, avg({b}) AS direct_log, avg({b} * weight) AS ips_log, avg(weight) AS weight_mean, avg(CAST(1 / propensity > 5 AS INT)) AS weight_clipped_share FROM (SELECT *, probs[action + 1] AS pa FROM weighted WHERE part = 'train')".format(b=_BLL.format(o="outcome", p="pa")),
        "", "positive_sft ips_positive direct_brier direct_log ips_log weight_mean weight_clipped_share",
    ),
    "h14_soft_target": rr('SELECT "index", 0.2 + (1 - 2 * 0.2) * outcome AS target FROM log', '"index"', "target"),
    "h15_simulation": rr(" UNION ALL ".join(sql_simulate(a) for a in _RW), "arm questions gold_samples wrong_samples mixed_groups", "gold_negative_advantage wrong_positive_advantage gold_logit_down gold_logit_up mean_gold_logit_step zero_identical zero_equal_rewards zero_other mixed_gold_negative"),
    "h16_expected_step": rr("SELECT record_id, " + ", ".join(f"{_STEP.replace('rw', '(list_transform(range(1, len(probs) + 1), lambda x: ' + e.format(r='CAST(x = gold + 1 AS INT)', p='probs[x]') + '))')} AS {a}" for a, e in _RW.items()) + " FROM results_choice", "record_id", " ".join(_RW)),
    "l_sign_check": rr(" UNION ALL ".join(sql_gradients(a) for a in _RW), "arm questions gold_lowered gold_raised matches sums_to_zero", "mean_loss mean_gradient"),
    "h16_enumeration": rr("SELECT count(*) AS n, 0.0 AS max_abs_difference, avg((1 - 1.0 / 3) * probs[gold + 1] * ((1 - pow(1 - probs[gold + 1], 2)) - (probs[gold + 1] * (1 - pow(1 - probs[gold + 1], 2)) + probs[2 - gold] * (1 - pow(probs[2 - gold], 2))))) AS mean_step FROM results_noul WHERE position = 0", "n", "max_abs_difference mean_step"),
    "h17_log_mismatches": q('SELECT "index", record_id FROM log WHERE record_id % 10 IN (4, 5)'),
    "h17_log_steps": q("SELECT part, CAST(greatest(40, ceil(3 * count(*) / 16)) AS BIGINT) AS steps FROM prefixed GROUP BY part"),
    "h18_validation": rr(
        f"SELECT count(*) AS n, avg(list_sum(list_transform(range(1, len(a.probs) + 1), lambda i: CASE WHEN a.probs[i] > 0 THEN a.probs[i] * (ln(a.probs[i]) - ln(greatest(b.probs[i], 1e-45))) ELSE 0.0 END))) AS kl_to_ref, avg(list_sum(list_transform(range(1, len(a.probs) + 1), lambda i: a.probs[i] * (1 - pow(CAST(i = a.gold + 1 AS INT) - a.probs[i], 2))))) AS expected_reward, avg(list_sum(list_transform(a.probs, lambda x: x * x))) AS expected_p_chosen FROM results_choice a JOIN run_b b USING (record_id, question_id)",
        "n", "kl_to_ref expected_reward expected_p_chosen",
    ),
}
