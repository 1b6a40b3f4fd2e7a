"""Expressions over one answer's distribution (an array of probabilities, one per option).

Options keep their order, arrays may differ in length from row to row, and a tie goes to the first
option. Everything here is built-in functions inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the metrics.
NLL_FLOOR = 1e-12
LOG_FLOOR = 1e-45
OUTCOME_CLIP = 1e-6
N_BINS = 15
THRESHOLDS = [round(0.05 * i, 2) for i in range(21)]
BUDGETS = [0.05, 0.10, 0.20]
SLACK = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def argmax(p: Column) -> Column:
    """The first option of the greatest probability, from 0."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def at(p: Column, i: Column) -> Column:
    """The element at a position counted from 0."""
    return F.get(p, i)


def prediction(qtype: Column, p: Column) -> Column:
    """Yes/no questions: yes (0) from one half on; others: the greatest probability."""
    return F.when(qtype == "noul", F.when(p[0] >= 0.5, 0).otherwise(1)).otherwise(argmax(p)).cast("int")


def entropy(p: Column) -> Column:
    return total(F.transform(p, lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)))


def entropy_confidence(p: Column) -> Column:
    """One minus the entropy as a share of that of the uniform distribution, in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - entropy(p) / F.log(F.size(p).cast("double"))))


def confidence(qtype: Column, p: Column) -> Column:
    return F.when(qtype == "noul", F.greatest(p[0], 1 - p[0])).otherwise(entropy_confidence(p))


def expected_level(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def brier(p: Column, gold: Column) -> Column:
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2.0))))


def nll(p: Column, gold: Column) -> Column:
    return -F.log(F.greatest(at(p, gold), F.lit(NLL_FLOOR)))


def bin_index(c: Column, n: int = N_BINS) -> Column:
    """Equal-width bins on [0, 1]; 1.0 falls in the last."""
    return F.least(F.floor(c * n).cast("int"), F.lit(n - 1))


def softmax(z: Column) -> Column:
    return let(F.array_max(z), lambda top: let(F.transform(z, lambda x: F.exp(x - top)), lambda w: let(total(w), lambda s: F.transform(w, lambda x: x / s))))


def logits(p: Column) -> Column:
    return F.transform(p, lambda x: F.log(F.greatest(x, F.lit(LOG_FLOOR))))


def tempered(p: Column, t: Column | float) -> Column:
    """The distribution with its logits divided by a temperature."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return softmax(F.transform(logits(p), lambda x: x / t))


def log_sum_exp(z: Column) -> Column:
    return let(F.array_max(z), lambda top: top + F.log(total(F.transform(z, lambda x: F.exp(x - top)))))


def tempered_nll(p: Column, gold: Column, t: Column) -> Column:
    return let(F.transform(logits(p), lambda x: x / t), lambda z: log_sum_exp(z) - at(z, gold))


def inverted(p: Column, f: float) -> Column:
    """Undo a flip channel of rate f: clip to [0, 1], renormalise; unchanged where all clip to 0."""
    raw = F.transform(p, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - f) / (1 - 2 * f))))
    return let(raw, lambda r: let(total(r), lambda s: F.when(s > 0, F.transform(r, lambda x: x / s)).otherwise(p)))


def behaviour(p: Column, epsilon: float) -> Column:
    """The logging policy: the distribution mixed with a uniform share epsilon."""
    return let(total(p), lambda s: F.transform(p, lambda x: (1 - epsilon) * x / s + epsilon / F.size(p)))


def inverse_cdf(q: Column, u: Column) -> Column:
    """The first option whose cumulative probability exceeds u; the last one on rounding."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(-1).alias("i"), F.lit(0).alias("n"))

    def step(a, x):
        s = a["s"] + x
        return F.struct(s.alias("s"), F.when((a["i"] < 0) & (u < s), a["n"]).otherwise(a["i"]).alias("i"), (a["n"] + 1).alias("n"))

    return F.aggregate(q, start, step, lambda a: F.when(a["i"] < 0, a["n"] - 1).otherwise(a["i"]))


def clipped(p: Column, eps: float = OUTCOME_CLIP) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def bernoulli(r: Column, p: Column) -> Column:
    """Log-likelihood of an outcome of 0 or 1."""
    return let(clipped(p), lambda q: r * F.log(q) + (1 - r) * F.log(1 - q))


def r6(x: Column) -> Column:
    return F.round(x, 6)
