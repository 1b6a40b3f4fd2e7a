"""Logged bandit feedback: behaviour policy, log, flips, prefixes, weights, rewards, advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions import distributions as D
from credence.functions.draws import digest, uniform
from credence.operators.sampling import seeded_rank

EPSILON, FLIP_RATE, TRAIN_SHARE = 0.1, 0.2, 0.9
WEIGHT_CLIP = 5.0
ARMS = ("outcome", "outcome_minus_p", "brier", "log")
TOLERANCE = 1e-9


def collect_log(results: DataFrame, seed: int, epsilon: float = EPSILON, flip_rate: float = FLIP_RATE) -> DataFrame:
    """The log of one action per question from the behaviour policy, in a seeded order. The gold
    answer is not kept; ``outcome`` tells whether the action was it, ``flipped`` passes it through a
    flip channel with a stream of its own."""
    ordered = seeded_rank(results, [], digest(f"v3_log_order:{seed}", F.col("record_id")), "index").withColumn("index", F.col("index") - 1)
    i = F.col("index")
    q = D.behaviour(F.col("probs"), epsilon)
    drawn = ordered.withColumn("act", D.let(q, lambda x: D.let(D.inverse_cdf(x, uniform(f"v3_log:{seed}", i)), lambda a: F.struct(a.cast("int").alias("action"), F.get(x, a).alias("propensity")))))
    outcome = (F.col("act.action") == F.col("gold")).cast("int")
    return drawn.select("index", "record_id", "question_id", "labels", "probs", "act.action", "act.propensity", outcome.alias("outcome"),
                        flip(outcome, seed, flip_rate, i).alias("flipped"))


def flip(outcome: Column, seed: int, rate: float, index: Column) -> Column:
    return F.when(uniform(f"v3_flip:{seed}", index) < rate, 1 - outcome).otherwise(outcome)


def reflip(log: DataFrame, seed: int, rate: float) -> DataFrame:
    """Flips redrawn at another rate from the log's own stream: a lower rate's flips are among a higher one's."""
    return log.withColumn("flipped", flip(F.col("outcome"), seed, rate, F.col("index")))


def prefix(log: DataFrame, n: int, train_share: float = TRAIN_SHARE) -> DataFrame:
    """The first n rows with their part: the first floor(share * n) train, the rest select."""
    cut = int(train_share * n + 1e-9)
    if not 0 < cut < n:
        raise ValueError(f"a prefix of {n} leaves a part empty")
    if log.where(F.col("index") == n - 1).isEmpty():
        raise ValueError(f"the log has fewer than {n} rows")
    return log.where(F.col("index") < n).withColumn("part", F.when(F.col("index") < cut, "train").otherwise("select"))


def p_action(probs: Column = None) -> Column:
    return D.at(F.col("probs") if probs is None else probs, F.col("action"))


def log_likelihood(log: DataFrame, by: list[str], outcome: str = "outcome") -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("n"), F.avg(D.bernoulli(F.col(outcome), p_action())).alias("log_likelihood"))


def log_statistics(log: DataFrame, epsilon: float = EPSILON, other: str = "other") -> DataFrame:
    """Where the negative outcomes are, how many the uniform share explains, and the checks of the log."""
    k = F.size("probs")
    top = F.col("action") == D.argmax(F.col("probs"))
    negative = F.col("outcome") == 0
    said_other = D.at(F.col("labels"), F.col("action")) == other
    count = lambda c: F.sum(c.cast("long"))
    worst = F.max(F.abs(D.at(D.behaviour(F.col("probs"), epsilon), F.col("action")) - F.col("propensity")))
    return log.agg(
        F.count("*").alias("n"), count(negative).alias("negatives"), count(negative & top).alias("on_top"), count(negative & ~top).alias("on_other"),
        (F.sum(F.when(negative & ~top, epsilon / k / F.col("propensity")).otherwise(0.0)) / count(negative & ~top)).alias("on_other_uniform_share"),
        count(negative & said_other).alias("chosen_other"), worst.alias("propensity_max_abs_diff"), F.avg("outcome").alias("outcome_rate"),
        F.avg((F.col("flipped") != F.col("outcome")).cast("int")).alias("flip_share"), F.avg("propensity").alias("mean_propensity"),
    )


def ips_weights(log: DataFrame, by: list[str], clip: float = WEIGHT_CLIP) -> DataFrame:
    """Inverse propensities, clipped and divided by their mean over the group; the mean is one row a group."""
    raw = F.least(1 / F.col("propensity"), F.lit(clip))
    means = log.groupBy(*by).agg(F.avg(raw).alias("normaliser"), F.avg((1 / F.col("propensity") > clip).cast("int")).alias("clipped_share"))
    return log.join(means, by).withColumn("weight", raw / F.col("normaliser"))


def importance_weight(p: Column, q: Column, clip: float = WEIGHT_CLIP) -> Column:
    return F.least(p / q, F.lit(clip))


def reward(arm: str, r: Column, p: Column) -> Column:
    if arm == "outcome":
        return r.cast("double")
    if arm == "outcome_minus_p":
        return r - p
    if arm == "brier":
        return 1 - (r - p) * (r - p)
    if arm == "log":
        return D.bernoulli(r, p)
    raise ValueError(f"unknown arm {arm!r}")


def soft_target(outcome: Column, rate: float) -> Column:
    return rate + (1 - 2 * rate) * outcome


def group_draws(results: DataFrame, size: int, epsilon: float, seed: str) -> DataFrame:
    """``size`` actions per question from the behaviour policy, one row each."""
    rows = results.withColumn("g", F.explode(F.sequence(F.lit(1), F.lit(size))))
    u = uniform(seed, F.col("record_id"), F.col("question_id"), F.col("g"))
    drawn = rows.withColumn("act", D.let(D.let(D.total(F.col("probs")), lambda s: F.transform("probs", lambda x: x / s)), lambda p: D.let(D.behaviour(p, epsilon), lambda q: D.let(D.inverse_cdf(q, u), lambda a: F.struct(a.cast("int").alias("action"), F.get(p, a).alias("p"), F.get(q, a).alias("q"), F.get(p, F.col("gold")).alias("p_gold"))))))
    return drawn.select("record_id", "question_id", "qtype", "gold", F.size("probs").alias("k"), "g", "act.*").withColumn("r", (F.col("action") == F.col("gold")).cast("int"))


def advantages(draws: DataFrame, arm: str, normalise: bool = False) -> DataFrame:
    """Reward minus the mean of the question's draws, optionally over their standard deviation. A
    question has a handful of draws."""
    w = Window.partitionBy("record_id", "question_id")
    d = draws.withColumn("reward", reward(arm, F.col("r"), F.col("p")))
    centred = F.col("reward") - F.avg("reward").over(w)
    return d.withColumn("advantage", centred / (F.stddev_pop("reward").over(w) + 1e-6) if normalise else centred)


def simulate(draws: DataFrame, arm: str, clip: float = WEIGHT_CLIP, tol: float = TOLERANCE) -> DataFrame:
    """What an arm's advantages do to the gold option: shares and mean steps over questions."""
    a = advantages(draws, arm).withColumn("w", importance_weight(F.col("p"), F.col("q"), clip))
    q = a.groupBy("record_id", "question_id").agg(
        F.avg(F.col("advantage") * F.col("w") * (F.col("r") - F.col("p_gold"))).alias("step"), F.sum("r").alias("n_gold"), F.count("*").alias("size"),
        F.sum((F.col("r") * (F.col("advantage") < -tol).cast("int"))).alias("gold_negative"), F.sum((1 - F.col("r")) * (F.col("advantage") > tol).cast("int")).alias("wrong_positive"),
        F.min("action").alias("a0"), F.max("action").alias("a1"), F.max(F.abs("advantage")).alias("widest"),
        F.avg(F.when(F.col("r") == 1, F.col("advantage"))).alias("gold_advantage"),
    )
    share = lambda c: F.avg(c.cast("int"))
    zero, same, mixed = F.abs("step") <= tol, F.col("a0") == F.col("a1"), (F.col("n_gold") > 0) & (F.col("n_gold") < F.col("size"))
    return q.agg(
        F.lit(arm).alias("arm"), F.count("*").alias("questions"), F.sum("n_gold").alias("gold_samples"), F.sum(F.col("size") - F.col("n_gold")).alias("wrong_samples"),
        (F.sum("gold_negative") / F.sum("n_gold")).alias("gold_negative_advantage"), (F.sum("wrong_positive") / F.sum(F.col("size") - F.col("n_gold"))).alias("wrong_positive_advantage"),
        share(F.col("step") < -tol).alias("gold_logit_down"), share(F.col("step") > tol).alias("gold_logit_up"), F.avg("step").alias("mean_gold_logit_step"),
        share(zero & same).alias("zero_identical"), share(zero & ~same & (F.col("widest") < tol)).alias("zero_equal_rewards"), share(zero & (F.col("widest") >= tol)).alias("zero_other"),
        F.sum(mixed.cast("int")).alias("mixed_groups"), F.avg(F.when(mixed, (F.col("gold_advantage") < -tol).cast("int"))).alias("mixed_gold_negative"),
    )


def expected_gold_step(p: Column, gold: Column, arm: str, size: int) -> Column:
    """``(1 - 1/G) p_g (R(g) - sum p R)``: the expected step of the gold logit."""
    rewards = F.transform(p, lambda x, i: reward(arm, F.when(i == gold, 1).otherwise(0), x))
    return D.let(rewards, lambda r: (1 - 1 / size) * D.at(p, gold) * (D.at(r, gold) - D.dot(p, r)))


def enumerated_gold_step(results: DataFrame, arm: str, size: int, epsilon: float, clip: float) -> DataFrame:
    """The same by summing over all tuples of ``size`` actions: K ** size rows a question, so for
    small K only."""
    k = F.size("probs")
    t = results.select("record_id", "question_id", "gold", "probs", D.behaviour(F.col("probs"), epsilon).alias("q"), F.explode(F.sequence(F.lit(0), F.pow(k, F.lit(size)).cast("int") - 1)).alias("t"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.struct((F.floor(F.col("t") / F.pow(F.size("probs"), j)) % F.size("probs")).cast("int").alias("a")))
    acts = F.transform(digits, lambda s: F.struct(F.get(F.col("probs"), s["a"]).alias("p"), F.get(F.col("q"), s["a"]).alias("q"), F.when(s["a"] == F.col("gold"), 1).otherwise(0).alias("r")))
    t = t.withColumn("acts", acts)
    t = t.withColumn("rewards", F.transform("acts", lambda s: reward(arm, s["r"], s["p"])))
    t = t.withColumn("mean_reward", D.total(F.col("rewards")) / size)
    terms = F.zip_with("acts", "rewards", lambda s, x: (x - F.col("mean_reward")) * F.least(s["p"] / s["q"], F.lit(clip)) * (s["r"] - D.at(F.col("probs"), F.col("gold"))))
    mass = F.aggregate("acts", F.lit(1.0), lambda m, s: m * s["q"])
    return t.groupBy("record_id", "question_id").agg(F.sum(mass * D.total(terms) / size).alias("step"))


def logit_gradients(results: DataFrame, draws: DataFrame, arm: str, clip: float = WEIGHT_CLIP, h: float = 1e-5) -> DataFrame:
    """By question: the loss ``-mean(A w ln p(a))`` over its draws, its gradient in the logits by hand, and
    the same by central differences of the loss. Advantages and weights stay fixed, as they do in a
    descent step. A question has a handful of draws, which become an array beside its options."""
    aw = F.col("advantage") * importance_weight(F.col("p"), F.col("q"), clip)
    acts = advantages(draws, arm).groupBy("record_id", "question_id").agg(F.collect_list(F.struct("action", aw.alias("aw"))).alias("acts"))
    j = results.select("record_id", "question_id", "gold", "probs").join(acts, ["record_id", "question_id"])
    j = j.withColumn("p", D.let(D.total(F.col("probs")), lambda s: F.transform("probs", lambda x: x / s))).withColumn("z", D.logits(F.col("p")))
    mean = lambda value: -D.total(F.transform("acts", value)) / F.size("acts")
    loss = lambda z: D.let(D.log_sum_exp(z), lambda s: mean(lambda a: a["aw"] * (F.get(z, a["action"]) - s)))
    moved = lambda i, by: F.transform("z", lambda x, k: x + F.when(k == i, by).otherwise(0.0))
    difference = lambda i: (D.let(moved(i, h), loss) - D.let(moved(i, -h), loss)) / (2 * h)
    hand = F.transform("p", lambda x, i: mean(lambda a: a["aw"] * (F.when(a["action"] == i, 1.0).otherwise(0.0) - x)))
    return j.select("record_id", "question_id", "gold", loss(F.col("z")).alias("loss"), hand.alias("gradient"), F.transform("z", lambda x, i: difference(i)).alias("by_difference"))


def gradient_check(gradients: DataFrame, arm: str, tol: float = 1e-6) -> DataFrame:
    """One row: how often a descent step lowers the gold logit, the mean loss and size of the gradient,
    and whether every gradient agrees with its finite differences and sums to zero."""
    g = gradients.withColumn("at_gold", D.at(F.col("gradient"), F.col("gold")))
    apart = F.array_max(F.zip_with("gradient", "by_difference", lambda a, b: F.abs(a - b)))
    return g.agg(
        F.lit(arm).alias("arm"), F.count("*").alias("questions"), F.count_if(F.col("at_gold") > TOLERANCE).alias("gold_lowered"), F.count_if(F.col("at_gold") < -TOLERANCE).alias("gold_raised"),
        F.avg("loss").alias("mean_loss"), F.avg(D.total(F.transform("gradient", F.abs))).alias("mean_gradient"),
        (F.max(apart) < tol).alias("matches"), (F.max(F.abs(D.total(F.col("gradient")))) < tol).alias("sums_to_zero"),
    )


def arm_losses(log: DataFrame, clip: float = WEIGHT_CLIP) -> DataFrame:
    """Mean loss values of the log-mode arms over the rows (column ``weight`` from the propensities)."""
    p, r = p_action(), F.col("outcome")
    positive = r == 1
    bce = -D.bernoulli(r, p)
    return log.agg(
        F.avg(F.when(positive, -F.log(p))).alias("positive_sft"), F.avg(F.when(positive, -F.log(p) * F.col("weight"))).alias("ips_positive"),
        F.avg((r - p) * (r - p)).alias("direct_brier"), F.avg(bce).alias("direct_log"), F.avg(bce * F.col("weight")).alias("ips_log"),
        F.avg(F.col("weight")).alias("weight_mean"), F.avg((1 / F.col("propensity") > clip).cast("int")).alias("weight_clipped_share"),
    )


def kl(p: Column, q: Column) -> Column:
    return D.total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * (F.log(x) - F.log(F.greatest(y, F.lit(D.LOG_FLOOR))))).otherwise(0.0)))


def validation(results: DataFrame, reference: DataFrame, arm: str) -> DataFrame:
    """KL to the reference run, expected reward under p, and expected p of the chosen action."""
    j = results.join(reference.select("record_id", "question_id", F.col("probs").alias("ref")), ["record_id", "question_id"])
    p = F.col("probs")
    rewards = F.transform(p, lambda x, i: x * reward(arm, F.when(i == F.col("gold"), 1).otherwise(0), x))
    return j.agg(F.count("*").alias("n"), F.avg(kl(p, F.col("ref"))).alias("kl_to_ref"), F.avg(D.total(rewards)).alias("expected_reward"), F.avg(D.dot(p, p)).alias("expected_p_chosen"))


def log_mismatches(log: DataFrame, records: DataFrame) -> DataFrame:
    """Logged rows whose record is missing or has its options in another order."""
    r = records.select("record_id", "question_id", F.col("labels").alias("stored"))
    return log.join(r, ["record_id", "question_id"], "left").where(F.col("stored").isNull() | (F.col("stored") != F.col("labels"))).select("index", "record_id")


def log_steps(n_train: Column, epochs: int, min_steps: int, batch: int) -> Column:
    return F.greatest(F.lit(min_steps), F.ceil(epochs * n_train / batch))
