"""Mixing sources to target weights by Poisson replication.

A source with share ``s`` of the documents gets the target share ``s ** TEMPERATURE``, normalised
(or the weights that are given). The mean repetition rate of its documents is target share times
wanted total over its count. Each document draws a uniform number from a hash of seed, id and text,
inverts the Poisson distribution of its source's rate with it, and is written that many times. A rate
above ``STEP`` is met by several draws, each with a hash stream and an equal share of the rate: their
sum has the Poisson distribution of the whole rate, so no rate is cut.

The copies are then shuffled globally: another hash of seed, row and copy, ``mix_key``, deals them to
partitions and orders each partition. The keys are uniform, so every order of the copies is as likely,
and no pass over the data is needed to find ranges.

Every draw depends on the row alone, so the result is the same whatever the partitions, and after
the loss of an executor. The hash is md5, so SQL engines give the same draws.

Defined results: documents without a source form a source of their own, with a weight under None if
weights are given. A source that is given no weight, or weight 0, gets no copies; weights of sources
that are absent count for nothing. Equal rows draw the same number. A null text draws as an empty
one. Columns of ``docs`` named ``mix_copy`` or ``mix_key`` give way to the new ones; all others pass
through. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPERATURE = 0.7
SEED = "mix-1"
#: Largest rate of one draw; the probability of zero is then a normal double.
STEP = 500.0
#: Sources up to which the table of rates is broadcast; beyond, it is joined by a shuffle, with the
#: rows of each source dealt over ``SALTS`` keys.
FEW_SOURCES = 10_000
SALTS = 64


def uniform(*key: Column) -> Column:
    """A uniform number in [0, 1) with 52 bits from an md5 of the key."""
    digest = F.md5(F.concat_ws(":", *key).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(rate: Column, seed: str, key: Column) -> Column:
    """A Poisson number of the given rate drawn from the key: the sum of ``ceil(rate / STEP)`` draws,
    the first from the stream ``seed:count``, the others from ``seed:count1`` and so on."""
    draws = F.greatest(F.ceil(rate / STEP), F.lit(1)).cast("int")
    one = inverse_poisson(uniform(F.lit(f"{seed}:count"), key), rate / draws)

    def several(bound: Column) -> Column:
        drawn = lambda n, i: n + inverse_poisson(uniform(F.concat(F.lit(f"{seed}:count"), i.cast("string")), bound), rate / draws)
        return F.aggregate(F.sequence(F.lit(1), draws - 1), F.lit(0), drawn)

    return one + F.when(draws > 1, F.transform(F.array(key), several)[0]).otherwise(F.lit(0))


def inverse_poisson(u: Column, rate: Column) -> Column:
    """The least k whose cumulative probability exceeds u, for rates up to STEP; terms are summed in order.

    The sum stops after ``rate + 12 * sqrt(rate) + 30`` terms, beyond which no double is left.
    """
    # inside a lambda an outside expression is evaluated at every step, so u is bound to a variable first
    return F.transform(F.array(u), lambda bound: _inverted(bound, rate))[0]


def _inverted(u: Column, rate: Column) -> Column:
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.exp(-rate)
    start = F.struct(zero.alias("p"), zero.alias("sum"), F.lit(0).alias("k"))

    def step(state, k):
        p = state["p"] * rate / k
        more = u >= state["sum"]
        return F.struct(
            p.alias("p"), F.when(more, state["sum"] + p).otherwise(state["sum"]).alias("sum"), F.when(more, k).otherwise(state["k"]).alias("k")
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])


def rates(docs: DataFrame, source_col: str = "source", weights: dict | None = None, total: float | None = None) -> DataFrame:
    """``(__mix_source, __mix_rate)`` by source; as many rows as there are sources."""
    by = docs.groupBy(F.col(source_col).alias("__mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        target = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "w_source string, w double")
        by = by.join(given, F.col("__mix_source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
        target = F.coalesce("w", F.lit(0.0))
    by = by.withColumn("target", target)
    sums = by.agg(F.sum("n").alias("all_n"), F.sum("target").alias("all_target"))
    wanted = F.lit(float(total)) if total is not None else F.col("all_n").cast("double")
    rate = F.when(F.col("all_target") > 0, F.col("target") / F.col("all_target") * wanted / F.col("n")).otherwise(F.lit(0.0))
    return by.join(F.broadcast(sums)).select("__mix_source", rate.alias("__mix_rate"))  # sums is one row


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, total: float | None = None,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with each row as often as drawn, in a global random order; ``mix_copy`` counts the
    copies of a row from 1 and ``mix_key`` is the key of the shuffle."""
    docs = docs.drop("mix_copy", "mix_key")
    names = docs.columns
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))
    by = rates(docs, source_col, weights, total)
    same = docs[source_col].eqNullSafe(by["__mix_source"])
    if by.count() <= FEW_SOURCES:
        joined = docs.join(F.broadcast(by), same)
    else:
        salted = docs.withColumn("__mix_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
        joined = salted.join(by.withColumn("__mix_salts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("__mix_salt") == F.col("__mix_salts")))
    drawn = joined.where("__mix_rate > 0").withColumn("__mix_key", key).withColumn("__mix_n", poisson_count(F.col("__mix_rate"), seed, F.col("__mix_key")))
    copies = drawn.where("__mix_n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))))
    copies = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.col("__mix_key"), F.col("mix_copy").cast("string")).cast("binary")))
    return copies.select(*names, "mix_copy", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")


def op4(docs: DataFrame) -> DataFrame:
    return mixed(docs.select("doc_id", "text", "lang", "source", "n_chars"))


ORACLE_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), aimed AS (
  SELECT source, n, pow(CAST(n AS DOUBLE), {TEMPERATURE}) AS target FROM sized
), rated AS (
  SELECT source, target / (SELECT sum(target) FROM aimed) * (SELECT CAST(sum(n) AS DOUBLE) FROM sized) / n AS whole FROM aimed
), split AS (
  SELECT source, CAST(greatest(ceil(whole / {STEP}), 1) AS INT) AS draws, whole / greatest(ceil(whole / {STEP}), 1) AS rate FROM rated
), terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS upto, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT) AS last FROM split
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), upto + p * rate / (k + 1), last FROM terms WHERE k < last
), tabled AS (
  SELECT source, list(upto ORDER BY k) AS cumulative FROM terms GROUP BY source
), keyed AS (
  SELECT *, row_number() OVER () AS number, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS key FROM documents
), drawn AS (
  SELECT number, CAST(('0x' || substr(md5('{SEED}:count' || CASE WHEN i = 0 THEN '' ELSE CAST(i AS VARCHAR) END || ':' || key), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u, cumulative
  FROM (SELECT number, key, cumulative, unnest(range(draws)) AS i FROM keyed d JOIN tabled t ON d.source IS NOT DISTINCT FROM t.source JOIN split s ON d.source IS NOT DISTINCT FROM s.source)
), counted AS (
  SELECT number, CAST(sum(len(list_filter(cumulative, lambda c: u >= c))) AS BIGINT) AS times FROM drawn GROUP BY number
)
SELECT doc_id, text, lang, source, n_chars, CAST(i AS INT) AS mix_copy, md5('{SEED}:order:' || key || ':' || CAST(i AS VARCHAR)) AS mix_key
FROM (SELECT *, unnest(range(1, times + 1)) AS i FROM keyed JOIN counted USING (number))
"""
