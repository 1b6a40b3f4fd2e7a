"""Result tables derived from the test tables, for queries that need answers with probabilities.

Probabilities are rounded to 9 digits where they are made, so that every engine computes from the
same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import distributions as D
from credence.functions.draws import uniform
from credence.session import tables

COLUMNS = ["record_id", "question_id", "split", "qtype", "kind", "position", "gold", "probs", "labels", "negated_p_yes", "cluster"]
LABELS = [f"c{i}" for i in range(9)] + ["other"]


def centroids(embeddings: DataFrame) -> DataFrame:
    """One row: the mean vector of each label, by label. Labels are options, 26 at most."""
    dims = embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = dims.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    by = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centre"))
    return by.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "centre"))), lambda s: s["centre"]).alias("centres"))


def results_choice(spark: SparkSession, sf_dir: str, t: float = 0.1, shift: float = 0.0) -> DataFrame:
    """Nearest-centroid softmax over ``embeddings``; every third record of a low label offers 6 options only.

    ``shift`` moves each label's centroid along its own dimensions, for a run with other predictions.
    """
    e = tables(spark, sf_dir, "embeddings")
    centres = centroids(e)
    if shift:
        centres = centres.select(F.transform("centres", lambda c, k: F.transform(c, lambda x, i: x + F.when(i % 10 == k, shift).otherwise(0.0))).alias("centres"))
    k = F.when((F.col("vec_id") % 3 == 0) & (F.col("label") < 6), 6).otherwise(10)
    squared = lambda c: D.total(F.zip_with(F.col("embedding"), c, lambda x, y: (x - y) * (x - y)))
    d2 = F.transform(F.slice("centres", F.lit(1), k), squared)
    probs = F.transform(D.softmax(F.transform(d2, lambda x: -x / t)), lambda x: F.round(x, 9))
    return e.join(F.broadcast(centres)).select(  # the centroids are one row
        F.col("vec_id").alias("record_id"), F.lit("label").alias("question_id"),
        F.when(F.col("vec_id") % 4 == 0, "valid").otherwise("test").alias("split"), F.lit("choice").alias("qtype"), F.lit("label").alias("kind"),
        F.lit(0).alias("position"), F.col("label").cast("int").alias("gold"), probs.alias("probs"),
        F.slice(F.array(*map(F.lit, LABELS)), F.lit(1), k).alias("labels"), F.lit(None).cast("double").alias("negated_p_yes"), F.col("vec_id").alias("cluster"),
    )


def results_noul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two yes/no questions for each labelled document, and the answers to their negations."""
    labels, docs = tables(spark, sf_dir, "labels", "documents")
    d = labels.join(docs, "doc_id").withColumn("position", F.explode(F.array(F.lit(0), F.lit(1))))
    z = (F.length("text") % 1000) / F.lit(500.0) - 1 + 2 * (uniform("noul", F.col("position"), F.col("doc_id")) - 0.5)
    d = d.withColumn("p", F.round(1 / (1 + F.exp(-z)), 9))
    wobble = 0.2 * (uniform("negated", F.col("position"), F.col("doc_id")) - 0.5)
    negated = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("p") + wobble)), 9)
    return d.select(
        F.col("doc_id").alias("record_id"), F.concat(F.lit("q"), F.col("position")).alias("question_id"),
        F.when(F.col("doc_id") % 4 == 0, "valid").otherwise("test").alias("split"), F.lit("noul").alias("qtype"), F.col("lang").alias("kind"), "position",
        F.when(F.col("quality") == 1, 0).otherwise(1).alias("gold"), F.array("p", F.round(1 - F.col("p"), 9)).alias("probs"),
        F.array(F.lit("true"), F.lit("false")).alias("labels"), negated.alias("negated_p_yes"), F.col("doc_id").alias("cluster"),
    )


def results_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-level question for each order; the gold level is its priority."""
    o = tables(spark, sf_dir, "orders").withColumn("gold", F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    z = F.array(*[2 * uniform(f"score{i}", F.col("o_orderkey")) + F.when(F.col("gold") == i, 1.2).otherwise(0.0) for i in range(5)])
    return o.select(
        F.col("o_orderkey").alias("record_id"), F.lit("priority").alias("question_id"),
        F.when(F.col("o_orderkey") % 4 == 0, "valid").otherwise("test").alias("split"), F.lit("score").alias("qtype"), F.lit("priority").alias("kind"),
        (F.col("o_orderkey") % 2).cast("int").alias("position"), "gold", F.transform(D.softmax(z), lambda x: F.round(x, 9)).alias("probs"),
        F.array(*[F.lit(str(i)) for i in range(5)]).alias("labels"), F.lit(None).cast("double").alias("negated_p_yes"), F.col("o_custkey").alias("cluster"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_choice(spark, sf_dir).unionByName(results_noul(spark, sf_dir)).unionByName(results_score(spark, sf_dir))


def interactions(spark: SparkSession, sf_dir: str, flip: float = 0.2, epsilon: float = 0.1) -> DataFrame:
    from credence.operators.feedback import collect_log

    return collect_log(results_choice(spark, sf_dir), seed=0, epsilon=epsilon, flip_rate=flip)


# --- the same tables in SQL ---------------------------------------------------------------------------


def sql_uniform(stream: str, *key: str) -> str:
    parts = " || ':' || ".join([f"'{stream}'", *[f"CAST({k} AS VARCHAR)" for k in key]])
    return f"(CAST('0x' || substr(md5({parts}), 1, 8) AS BIGINT) / 4294967296.0)"


def sql_softmax(z: str) -> str:
    """A list expression with the softmax of a list expression."""
    w = f"list_transform({z}, lambda y: exp(y - list_max({z})))"
    return f"list_transform({w}, lambda w: w / list_sum({w}))"


def _sql_choice(t: float, shift: float) -> str:
    return f"""
    SELECT vec_id AS record_id, 'label' AS question_id, CASE WHEN vec_id % 4 = 0 THEN 'valid' ELSE 'test' END AS split, 'choice' AS qtype,
      'label' AS kind, 0 AS position, CAST(min(label) AS INT) AS gold, list(round(w / z, 9) ORDER BY k) AS probs,
      list(CASE WHEN k < 9 THEN 'c' || k ELSE 'other' END ORDER BY k) AS labels, CAST(NULL AS DOUBLE) AS negated_p_yes, vec_id AS cluster
    FROM (SELECT *, sum(w) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z
      FROM (SELECT vec_id, label, k, exp((min(d2) OVER (PARTITION BY vec_id) - d2) / {t}) AS w
        FROM (SELECT e.vec_id, e.label, c.label AS k, list_sum(list_transform(range(1, 65), lambda i: pow(e.embedding[i] - c.centre[i] - CASE WHEN (i - 1) % 10 = c.label THEN {shift} ELSE 0.0 END, 2))) AS d2
          FROM embeddings e JOIN centroids c ON c.label < CASE WHEN e.vec_id % 3 = 0 AND e.label < 6 THEN 6 ELSE 10 END)))
    GROUP BY vec_id"""


SQL_FIXTURES: dict[str, str] = {
    "centroids": """
    SELECT label, list(m ORDER BY pos) AS centre FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label""",
    "results_choice": _sql_choice(0.1, 0.0),
    "run_b": _sql_choice(1.0, 0.0),
    "run_c": _sql_choice(0.05, 0.15),
    "results_noul": f"""
    SELECT doc_id AS record_id, 'q' || position AS question_id, CASE WHEN doc_id % 4 = 0 THEN 'valid' ELSE 'test' END AS split, 'noul' AS qtype,
      lang AS kind, position, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS gold, [p, round(1 - p, 9)] AS probs, ['true', 'false'] AS labels,
      round(least(1.0, greatest(0.0, 1 - p + 0.2 * ({sql_uniform("negated", "position", "doc_id")} - 0.5))), 9) AS negated_p_yes, doc_id AS cluster
    FROM (SELECT *, round(1 / (1 + exp(-((length(text) % 1000) / 500.0 - 1 + 2 * ({sql_uniform("noul", "position", "doc_id")} - 0.5)))), 9) AS p
      FROM labels JOIN documents USING (doc_id), (SELECT unnest([0, 1]) AS position))""",
    "results_score": f"""
    SELECT o_orderkey AS record_id, 'priority' AS question_id, CASE WHEN o_orderkey % 4 = 0 THEN 'valid' ELSE 'test' END AS split, 'score' AS qtype,
      'priority' AS kind, CAST(o_orderkey % 2 AS INT) AS position, gold, list_transform({sql_softmax("z")}, lambda x: round(x, 9)) AS probs,
      ['0', '1', '2', '3', '4'] AS labels, CAST(NULL AS DOUBLE) AS negated_p_yes, o_custkey AS cluster
    FROM (SELECT *, [{", ".join(f"2 * {sql_uniform(f'score{i}', 'o_orderkey')} + CASE WHEN gold = {i} THEN 1.2 ELSE 0.0 END" for i in range(5))}] AS z
      FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS gold FROM orders))""",
    "results": "SELECT * FROM results_choice UNION ALL SELECT * FROM results_noul UNION ALL SELECT * FROM results_score",
    "answers": """
    SELECT *, len(probs) AS k, CAST(CASE WHEN qtype = 'noul' THEN CASE WHEN probs[1] >= 0.5 THEN 0 ELSE 1 END ELSE list_position(probs, list_max(probs)) - 1 END AS INT) AS prediction,
      list_max(probs) AS top1, CASE WHEN qtype = 'noul' THEN greatest(probs[1], 1 - probs[1])
        ELSE greatest(0.0, least(1.0, 1 + list_sum(list_transform(probs, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0.0 END)) / ln(len(probs)))) END AS confidence
    FROM results""",
    "judged": "SELECT *, CAST(prediction = gold AS INT) AS hit FROM answers",
    "judged_choice": "SELECT * FROM judged WHERE qtype = 'choice'",
}


def oracle(body: str, **more: str) -> str:
    """SQL with the fixtures it names, in the order they need each other."""
    import re

    known = SQL_FIXTURES | more
    order: list[str] = []

    def add(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text):
                add(known[name]) if known[name] is not text else None
                if name not in order:
                    order.append(name)

    add(body)
    named = ",\n".join(f"{n} AS ({known[n]})" for n in order)
    return f"WITH {named}\n{body}" if order else body


def sql_slots(resamples: int, seed: str, of: str) -> str:
    """Poisson(1) weights of the records of a table in each resample, by cubes modulo a prime."""
    key = f"CAST('0x' || substr(md5('{seed}:' || CAST(record_id AS VARCHAR)), 1, 15) AS BIGINT)"
    x = f"""SELECT record_id, CAST(b AS BIGINT) AS b, k % 2147483579 + (k // 2147483579 % 2147483578 + 1) * (b + 1) % 2147483579 AS x
      FROM (SELECT record_id, {key} AS k FROM (SELECT DISTINCT record_id FROM {of})), (SELECT unnest(range({resamples})) AS b)"""
    for c in (1013904223, 1664525, 69069):
        x = f"SELECT record_id, b, y * y % 2147483579 * y % 2147483579 AS x FROM (SELECT record_id, b, (x + {c}) % 2147483579 AS y FROM ({x}))"
    cuts, term, total = [], 0.36787944117144233, 0.0
    for i in range(12):
        total += term
        cuts.append(total)
        term /= i + 1
    return f"SELECT * FROM (SELECT record_id, b, len(list_filter({cuts}, lambda c: c <= x / 2147483579.0)) AS w FROM ({x})) WHERE w > 0"
