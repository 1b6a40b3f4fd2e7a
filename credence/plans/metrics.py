"""Queries of the metrics section and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from credence.functions import distributions as D
from credence.operators import metrics as M
from credence.operators import report
from credence.plans import fixtures as X
from credence.plans.fixtures import oracle, sql_slots, sql_uniform
from credence.session import tables


def rounded(df, *keep: str):
    """Every double rounded to 6 decimals."""
    return df.select(*[D.r6(F.col(c)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def judged(spark, sf):
    return M.answers(X.results(spark, sf))


def choice(spark, sf):
    return M.answers(X.results_choice(spark, sf))


def noul(spark, sf):
    return M.answers(X.results_noul(spark, sf))


def score(spark, sf):
    return M.answers(X.results_score(spark, sf))


def runs(spark, sf):
    a = choice(spark, sf).withColumn("run", F.lit("a"))
    b = M.answers(X.results_choice(spark, sf, 1.0)).withColumn("run", F.lit("b"))
    c = M.answers(X.results_choice(spark, sf, 0.05, 0.15)).withColumn("run", F.lit("c"))
    return a.unionByName(b).unionByName(c)


def shuffled(spark, sf):
    c = X.results_choice(spark, sf, 0.05, 0.15).select("record_id", F.col("probs").alias("shuffled_probs"))
    a = X.results_choice(spark, sf).join(c, "record_id").select("qtype", "gold", "probs", "shuffled_probs")
    n = X.results_noul(spark, sf).select("qtype", "gold", "probs", F.array(D.r6(1 - F.col("negated_p_yes")), D.r6(F.col("negated_p_yes"))).alias("shuffled_probs"))
    return a.unionByName(n)


def reported(spark, sf):
    """The report of each split; later yes/no questions ask about the form, choices have a reordered copy."""
    r = X.results(spark, sf).withColumn("kind", F.when((F.col("qtype") == "noul") & (F.col("position") == 1), "contains_comma").otherwise(F.col("kind")))
    c = X.results_choice(spark, sf, 0.05, 0.15).select("record_id", "question_id", F.col("probs").alias("shuffled_probs"))
    return report.split_report(M.answers(r.join(c, ["record_id", "question_id"], "left")))


def lines_round_trip(spark, sf):
    """Results as JSON lines and back under the fixed schema."""
    r = X.results(spark, sf)
    schema = "record_id long, question_id string, split string, qtype string, kind string, position int, gold int, probs array<double>, labels array<string>, negated_p_yes double, cluster long"
    back = r.select(F.to_json(F.struct(*r.columns)).alias("line")).select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return M.answers(back).groupBy("qtype").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum("gold").alias("golds"), D.r6(F.sum("top1")).alias("top1"))


QUERIES = {
    "d1_prediction": lambda s, d: judged(s, d).select("record_id", "question_id", "qtype", "prediction"),
    "d2_row_values": lambda s, d: rounded(judged(s, d).select("record_id", "question_id", "qtype", "k", "hit", "top1", F.when(F.col("qtype") == "score", D.expected_level(F.col("probs"))).alias("expected_level"))),
    "d3_confidence": lambda s, d: rounded(judged(s, d).select("record_id", "question_id", "qtype", "confidence")),
    "d4_reliability": lambda s, d: rounded(M.reliability(judged(s, d), ["qtype"])),
    "d5_ece": lambda s, d: rounded(M.ece(judged(s, d), ["qtype"])),
    "d6_proper_scores": lambda s, d: rounded(M.proper_scores(judged(s, d), ["qtype"])),
    "d7_macro_f1": lambda s, d: rounded(M.macro_f1(choice(s, d), ["split"])),
    "d8_coverage_curve": lambda s, d: rounded(M.coverage_curve(judged(s, d), ["qtype"])),
    "d8_mean_absolute_error": lambda s, d: rounded(score(s, d).groupBy("split").agg(F.avg(F.abs(D.expected_level(F.col("probs")) - F.col("gold"))).alias("mae"))),
    "d9_aurc": lambda s, d: rounded(M.aurc(judged(s, d), ["qtype"])),
    "d10_coverage_at_risk": lambda s, d: rounded(M.coverage_at_risk(judged(s, d), ["qtype"])),
    "d11_risk_coverage_block": lambda s, d: rounded(M.risk_coverage_block(judged(s, d), ["qtype"])),
    "d12_letter_bias": lambda s, d: rounded(M.letter_bias(choice(s, d))),
    "d13_noul_by_kind": lambda s, d: rounded(M.noul_by_kind(noul(s, d))),
    "d14_by_position": lambda s, d: rounded(M.by_position(noul(s, d))),
    "d15_score_levels": lambda s, d: rounded(M.score_levels(score(s, d))),
    "d16_order_sensitivity": lambda s, d: rounded(M.order_sensitivity(shuffled(s, d))),
    "d17_by_gold_other": lambda s, d: rounded(M.by_gold_other(choice(s, d))),
    "d18_symmetry": lambda s, d: rounded(M.symmetry(X.results_noul(s, d))),
    "d19_max_abs_difference": lambda s, d: rounded(M.max_abs_difference(X.results_choice(s, d), X.results_choice(s, d, 1.0))),
    "d19_timing": lambda s, d: rounded(M.timing_summary(tables(s, d, "events"), "value", ["event_type"])),
    "d20_split_metrics": lambda s, d: rounded(M.split_metrics(judged(s, d))),
    "d20_split_report": lambda s, d: rounded(reported(s, d)),
    "d21_lines_round_trip": lines_round_trip,
    "d23_reordered": lambda s, d: X.results_choice(s, d).select("record_id", F.array_join(M.seeded_order(F.col("labels"), "order", F.col("record_id")), ",").alias("labels")),
    "d24_mean_ece": lambda s, d: rounded(M.ece(choice(s, d), ["split"]).agg(F.avg("ece").alias("mean_ece"), F.count("*").alias("splits"))),
    "d25_pooled_coverage": lambda s, d: rounded(M.pooled_coverage(runs(s, d))),
}

_ECE = "SELECT {by}, sum(abs(h - c)) / sum(n) AS ece, sum(n) AS n FROM (SELECT {by}, least(CAST(floor(top1 * 15) AS INT), 14) AS bin, count(*) AS n, sum(hit) AS h, sum(top1) AS c FROM {of} GROUP BY ALL) GROUP BY ALL"


def ece_sql(by: str, of: str = "judged") -> str:
    return _ECE.format(by=by, of=of)


def ranked_sql(by: str, value: str, of: str = "judged") -> str:
    """Each rank with the expected errors down to it."""
    return f"""
    SELECT {by}, v, total, before_w + j AS kept, before_e + rate * j AS errors, j = w AS closes FROM (
      SELECT {by}, {value} AS v, count(*) OVER (PARTITION BY {by}) AS total,
        row_number() OVER (PARTITION BY {by}, {value} ORDER BY record_id, question_id) AS j, count(*) OVER (PARTITION BY {by}, {value}) AS w,
        avg(1 - hit) OVER (PARTITION BY {by}, {value}) AS rate,
        count(*) OVER (PARTITION BY {by} ORDER BY {value} DESC) - count(*) OVER (PARTITION BY {by}, {value}) AS before_w,
        sum(1 - hit) OVER (PARTITION BY {by} ORDER BY {value} DESC) - sum(1 - hit) OVER (PARTITION BY {by}, {value}) AS before_e
      FROM {of})"""


def at_risk_sql(by: str, ranked: str) -> str:
    best = f"(SELECT * FROM {ranked} WHERE closes)"
    return f"""
    SELECT {by}, budget, coalesce(max(CASE WHEN errors / kept <= budget + 1e-12 THEN kept END), 0) / max(total) AS coverage,
      CAST(coalesce(max(CASE WHEN errors / kept <= budget + 1e-12 THEN kept END), 0) AS BIGINT) AS n,
      1 - arg_max(errors / kept, kept) FILTER (WHERE errors / kept <= budget + 1e-12) AS accuracy,
      arg_max(v, kept) FILTER (WHERE errors / kept <= budget + 1e-12) AS threshold
    FROM {best}, (SELECT unnest([0.05, 0.10, 0.20]) AS budget) GROUP BY {by}, budget"""


def r(q: str, keys: str, values: str, **more: str) -> str:
    """Round the value columns of a query."""
    cols = ", ".join([*filter(None, keys.split()), *(f"round(CAST({v} AS DOUBLE), 6) AS {v}" for v in values.split())])
    return oracle(f"SELECT {cols} FROM ({q})", **more)


_CURVE = """
SELECT {by}, CAST(threshold AS DOUBLE) AS threshold, avg(CAST(confidence >= threshold - 1e-12 AS INT)) AS coverage,
  CAST(sum(CAST(confidence >= threshold - 1e-12 AS INT)) AS BIGINT) AS n, avg(hit) FILTER (WHERE confidence >= threshold - 1e-12) AS accuracy
FROM {of}, (SELECT round(unnest(range(21)) * 0.05, 2) AS threshold) GROUP BY {by}, threshold"""
_PROPER = """
SELECT {by}, count(*) AS n, avg(hit) AS accuracy,
  avg(list_sum(list_transform(range(len(probs)), lambda i: pow(probs[i + 1] - CASE WHEN i = gold THEN 1 ELSE 0 END, 2)))) AS brier,
  avg(-ln(greatest(probs[gold + 1], 1e-12))) AS nll FROM {of} GROUP BY {by}"""
_LEVEL = "list_sum(list_transform(range(len(probs)), lambda i: i * probs[i + 1]))"
_RUNS = {
    f"judged_{n}": f"SELECT '{n}' AS run, *, CAST(prediction = gold AS INT) AS hit FROM (SELECT *, len(probs) AS k, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS prediction, list_max(probs) AS top1, greatest(0.0, least(1.0, 1 + list_sum(list_transform(probs, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0.0 END)) / ln(len(probs)))) AS confidence FROM {t})"
    for n, t in (("a", "results_choice"), ("b", "run_b"), ("c", "run_c"))
} | {"all_runs": "SELECT * FROM judged_a UNION ALL SELECT * FROM judged_b UNION ALL SELECT * FROM judged_c"}
_WHERE = "CASE WHEN position = 0 THEN 'first' ELSE 'later' END"
_PRED = "CAST(CASE WHEN qtype = 'noul' THEN CASE WHEN {p}[1] >= 0.5 THEN 0 ELSE 1 END ELSE list_position({p}, list_max({p})) - 1 END AS INT)"
_SHUFFLED = {
    "pairs": "SELECT a.qtype, a.gold, a.probs, c.probs AS shuffled FROM results_choice a JOIN run_c c USING (record_id) UNION ALL SELECT qtype, gold, probs, [round(1 - negated_p_yes, 6), round(negated_p_yes, 6)] FROM results_noul",
    "moves": f"SELECT qtype, CAST({_PRED.format(p='probs')} = gold AS INT) AS h, CAST({_PRED.format(p='shuffled')} = gold AS INT) AS s, CAST({_PRED.format(p='probs')} = {_PRED.format(p='shuffled')} AS INT) AS same, list_max(list_transform(range(1, len(probs) + 1), lambda i: abs(probs[i] - shuffled[i]))) AS d FROM pairs",
}
_SPLIT_ROWS = {
    "split_rows": f"""
    SELECT *, 'overall' AS block, 'all' AS name FROM judged UNION ALL SELECT *, 'type', qtype FROM judged
    UNION ALL SELECT *, 'kind', qtype || '/' || kind FROM judged UNION ALL SELECT *, 'place', qtype || '/' || {_WHERE} FROM judged"""
}

_BY = "split, block"
_TYPED = {
    "typed": "SELECT j.* REPLACE (CASE WHEN j.qtype = 'noul' AND j.position = 1 THEN 'contains_comma' ELSE j.kind END AS kind), CASE WHEN j.qtype = 'noul' AND j.position = 1 THEN 'form' ELSE j.qtype END AS block, c.probs AS shuffled FROM judged j LEFT JOIN run_c c ON j.record_id = c.record_id AND j.question_id = c.question_id",
    "keyed": f"""
    SELECT * REPLACE ('overall' AS block), 'all' AS part FROM typed WHERE block <> 'form' UNION ALL SELECT *, 'all' FROM typed UNION ALL SELECT *, 'place:' || {_WHERE} FROM typed
    UNION ALL SELECT *, 'kind:' || kind FROM typed WHERE qtype = 'noul' UNION ALL SELECT *, 'k:' || k FROM typed WHERE qtype = 'choice' UNION ALL SELECT *, 'gold:' || gold FROM typed WHERE qtype = 'choice'
    UNION ALL SELECT *, 'k:' || k || '/gold:' || gold FROM typed WHERE qtype = 'choice' UNION ALL SELECT *, 'offering' FROM typed WHERE qtype = 'choice' AND list_contains(labels, 'other')
    UNION ALL SELECT *, CASE WHEN labels[gold + 1] = 'other' THEN 'gold_other' ELSE 'gold_named' END FROM typed WHERE qtype = 'choice' AND list_contains(labels, 'other')""",
    "means": f"""
    SELECT split, block, part, count(*) AS n, avg(hit) AS accuracy, avg(list_sum(list_transform(range(len(probs)), lambda i: pow(probs[i + 1] - CASE WHEN i = gold THEN 1 ELSE 0 END, 2)))) AS brier, avg(-ln(greatest(probs[gold + 1], 1e-12))) AS nll,
      avg(CAST(prediction = 0 AS INT)) AS yes_rate, avg(probs[gold + 1]) AS mean_gold_probability, avg(CAST(labels[prediction + 1] = 'other' AS INT)) AS predicted_other_rate, avg(abs({_LEVEL} - gold)) AS mae FROM keyed GROUP BY ALL""",
    "bins": "SELECT split, block, part, least(CAST(floor(top1 * 15) AS INT), 14) AS bin, count(*) AS n, avg(top1) AS c, avg(hit) AS h FROM keyed GROUP BY ALL",
    "pois": sql_slots(1000, "report", "judged"),
    "draws": "SELECT split, block, b, sum(h) / sum(n) AS accuracy, sum(abs(h - c)) / sum(n) AS ece FROM (SELECT split, block, b, least(CAST(floor(top1 * 15) AS INT), 14) AS bin, sum(w) AS n, sum(w * hit) AS h, sum(w * top1) AS c FROM (SELECT split, block, record_id, top1, hit FROM keyed WHERE part = 'all') x JOIN pois USING (record_id) WHERE w > 0 GROUP BY ALL) GROUP BY ALL",
    "ends": "SELECT split, block, 'all' AS part, quantile_cont(accuracy, 0.025) AS accuracy_lo, quantile_cont(accuracy, 0.975) AS accuracy_hi, quantile_cont(ece, 0.025) AS ece_lo, quantile_cont(ece, 0.975) AS ece_hi FROM draws GROUP BY ALL",
    "curve": _CURVE.format(by=_BY, of="typed"), "by_top1": ranked_sql(_BY, "top1", "typed"), "by_entropy": ranked_sql(_BY, "confidence", "typed"),
    "risks": " UNION ALL ".join(f"SELECT split, block, 'risk:{n}:' || printf('%.2f', budget) AS part, coverage, n, accuracy, threshold FROM ({at_risk_sql(_BY, t)})" for n, t in (("top1", "by_top1"), ("entropy", "by_entropy"))),
    "areas": " UNION ALL ".join(f"SELECT split, block, 'risk:{n}' AS part, avg(errors / kept) AS aurc FROM {t} GROUP BY ALL" for n, t in (("top1", "by_top1"), ("entropy", "by_entropy"))),
    "f1": "SELECT split, 'choice' AS block, 'all' AS part, avg(f) AS macro_f1 FROM (SELECT g.split, g.label, 2.0 * tp / (golds + coalesce(preds, 0)) AS f FROM (SELECT split, labels[gold + 1] AS label, count(*) AS golds, sum(hit) AS tp FROM judged_choice GROUP BY ALL) g LEFT JOIN (SELECT split, labels[prediction + 1] AS label, count(*) AS preds FROM judged_choice GROUP BY ALL) p ON g.split = p.split AND g.label = p.label) GROUP BY split",
    "levels": f"SELECT split, 'score' AS block, 'levels:' || k || '/' || {_WHERE} || '/' || level AS part, avg(CAST(prediction = level AS INT)) AS predicted_share, avg(CAST(gold = level AS INT)) AS gold_share FROM (SELECT * FROM judged WHERE qtype = 'score'), (SELECT unnest(range(5)) AS level) GROUP BY ALL",
    "even": "SELECT split, block, part, count(*) AS n, avg(probs[1] + negated_p_yes) AS mean_sum, stddev_pop(probs[1] + negated_p_yes) AS std_sum, avg(CAST((probs[1] >= 0.5) <> (negated_p_yes >= 0.5) AS INT)) AS argmax_consistent FROM (SELECT *, unnest(['symmetry', 'symmetry:' || kind]) AS part FROM typed WHERE qtype = 'noul') GROUP BY ALL",
    "moved": f"SELECT split, 'overall' AS block, 'order:' || name AS part, count(*) AS n, avg(hit) AS accuracy, avg(CAST({_PRED.format(p='shuffled')} = gold AS INT)) AS accuracy_shuffled, avg(CAST({_PRED.format(p='shuffled')} = prediction AS INT)) AS prediction_agreement, avg(d) AS mean_max_abs_difference, max(d) AS max_abs_difference FROM (SELECT *, unnest([qtype, 'overall']) AS name, list_max(list_transform(range(1, len(probs) + 1), lambda i: abs(probs[i] - shuffled[i]))) AS d FROM typed WHERE shuffled IS NOT NULL) GROUP BY ALL",
    "counted": "SELECT split, 'overall' AS block, 'all' AS part, count(DISTINCT record_id) AS n_records FROM judged GROUP BY split",
    "eces": ece_sql("split, block, part", "keyed"),
    "thresholds": "SELECT split, block, 'threshold:' || printf('%.2f', threshold) AS part, coverage, n, accuracy FROM curve",
    "reliable": "SELECT split, block, 'bin:' || bin AS part, n AS count, c AS mean_confidence, h AS mean_accuracy FROM bins WHERE part = 'all'",
}


def _metric_rows() -> str:
    whole, yes = "part = 'all'", "block IN ('noul', 'form')"
    shown = [
        ("means", "n", "true"), ("means", "accuracy", "true"), ("eces", "ece", "part = 'all' OR part LIKE 'place:%' OR part LIKE 'kind:%'"), ("means", "brier", whole), ("means", "nll", whole),
        ("means", "yes_rate", f"{yes} AND (part = 'all' OR part LIKE 'kind:%')"), ("means", "mean_gold_probability", "part LIKE 'k:%' OR part LIKE 'gold:%'"),
        ("means", "predicted_other_rate", "part IN ('offering', 'gold_other', 'gold_named')"), ("means", "mae", f"block = 'score' AND {whole}"), ("counted", "n_records", "true"), ("areas", "aurc", "true"), ("f1", "macro_f1", "true"),
    ]
    for table, names in (("reliable", "count mean_confidence mean_accuracy"), ("ends", "accuracy_lo accuracy_hi ece_lo ece_hi"), ("thresholds", "coverage n accuracy"), ("risks", "coverage n accuracy threshold"), ("levels", "predicted_share gold_share"),
                         ("even", "n mean_sum std_sum argmax_consistent"), ("moved", "n accuracy accuracy_shuffled prediction_agreement mean_max_abs_difference max_abs_difference")):
        shown += [(table, n, "true") for n in names.split()]
    return " UNION ALL ".join(f"SELECT split, block, part, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {t} WHERE {w}" for t, m, w in shown)


ORACLES = {
    "d1_prediction": oracle("SELECT record_id, question_id, qtype, prediction FROM judged"),
    "d2_row_values": r(f"SELECT * REPLACE (CAST(k AS INT) AS k), CASE WHEN qtype = 'score' THEN {_LEVEL} END AS expected_level FROM judged", "record_id question_id qtype k hit", "top1 expected_level"),
    "d3_confidence": r("SELECT * FROM judged", "record_id question_id qtype", "confidence"),
    "d4_reliability": r(
        "SELECT qtype, bin, coalesce(count, 0) AS count, mean_confidence, mean_accuracy FROM (SELECT * FROM (SELECT DISTINCT qtype FROM judged), (SELECT CAST(unnest(range(15)) AS INT) AS bin)) e LEFT JOIN "
        "(SELECT qtype, least(CAST(floor(top1 * 15) AS INT), 14) AS bin, count(*) AS count, avg(top1) AS mean_confidence, avg(hit) AS mean_accuracy FROM judged GROUP BY ALL) USING (qtype, bin)",
        "qtype bin count", "mean_confidence mean_accuracy",
    ),
    "d5_ece": r(f"SELECT qtype, ece, CAST(n AS BIGINT) AS n FROM ({ece_sql('qtype')})", "qtype n", "ece"),
    "d6_proper_scores": r(_PROPER.format(by="qtype", of="judged"), "qtype n", "accuracy brier nll"),
    "d7_macro_f1": r(
        "SELECT split, avg(f) AS macro_f1, count(*) AS n_labels FROM (SELECT g.split, g.label, 2.0 * tp / (golds + coalesce(preds, 0)) AS f FROM "
        "(SELECT split, labels[gold + 1] AS label, count(*) AS golds, sum(hit) AS tp FROM judged_choice GROUP BY ALL) g LEFT JOIN "
        "(SELECT split, labels[prediction + 1] AS label, count(*) AS preds FROM judged_choice GROUP BY ALL) p ON g.split = p.split AND g.label = p.label) GROUP BY split",
        "split n_labels", "macro_f1",
    ),
    "d8_coverage_curve": r(_CURVE.format(by="qtype", of="judged"), "qtype n", "threshold coverage accuracy"),
    "d8_mean_absolute_error": r(f"SELECT split, avg(abs({_LEVEL} - gold)) AS mae FROM judged WHERE qtype = 'score' GROUP BY split", "split", "mae"),
    "d9_aurc": r("SELECT qtype, avg(errors / kept) AS aurc FROM ranked GROUP BY qtype", "qtype", "aurc", ranked=ranked_sql("qtype", "top1")),
    "d10_coverage_at_risk": r(at_risk_sql("qtype", "ranked"), "qtype n", "budget coverage accuracy threshold", ranked=ranked_sql("qtype", "top1")),
    "d11_risk_coverage_block": r(
        " UNION ALL ".join(f"SELECT '{n}' AS ranking, c.*, aurc FROM ({at_risk_sql('qtype', t)}) c JOIN (SELECT qtype, avg(errors / kept) AS aurc FROM {t} GROUP BY qtype) USING (qtype)" for n, t in (("top1", "ranked"), ("entropy", "ranked2"))),
        "ranking qtype n", "budget coverage accuracy threshold aurc", ranked=ranked_sql("qtype", "top1"), ranked2=ranked_sql("qtype", "confidence"),
    ),
    "d12_letter_bias": r("SELECT CAST(k AS INT) AS k, gold AS gold_position, count(*) AS n, avg(hit) AS accuracy, avg(probs[gold + 1]) AS mean_gold_probability FROM judged_choice GROUP BY GROUPING SETS ((k), (gold), (k, gold))", "k gold_position n", "accuracy mean_gold_probability"),
    "d13_noul_by_kind": r(f"SELECT kind, CAST(n AS BIGINT) AS n, ece, accuracy, yes_rate FROM ({ece_sql('kind', 'nouls')}) JOIN (SELECT kind, avg(hit) AS accuracy, avg(CAST(prediction = 0 AS INT)) AS yes_rate FROM nouls GROUP BY kind) USING (kind)", "kind n", "ece accuracy yes_rate", nouls="SELECT * FROM judged WHERE qtype = 'noul'"),
    "d14_by_position": r(f'SELECT "where", CAST(n AS BIGINT) AS n, ece, accuracy FROM ({ece_sql(chr(34) + "where" + chr(34), "placed")}) JOIN (SELECT "where", avg(hit) AS accuracy FROM placed GROUP BY 1) USING ("where")', '"where" n', "ece accuracy", placed=f'SELECT *, {_WHERE} AS "where" FROM judged WHERE qtype = \'noul\''),
    "d15_score_levels": r(
        f'SELECT CAST(k AS INT) AS k, "where", level, count(*) AS n, avg(CAST(prediction = level AS INT)) AS predicted_share, avg(CAST(gold = level AS INT)) AS gold_share FROM (SELECT *, {_WHERE} AS "where" FROM judged WHERE qtype = \'score\'), (SELECT CAST(unnest(range(5)) AS INT) AS level) GROUP BY ALL',
        'k "where" level n', "predicted_share gold_share",
    ),
    "d16_order_sensitivity": r("SELECT coalesce(qtype, 'overall') AS qtype, count(*) AS n, avg(h) AS accuracy, avg(s) AS accuracy_shuffled, avg(same) AS prediction_agreement, avg(d) AS mean_max_abs_difference, max(d) AS max_abs_difference FROM moves GROUP BY GROUPING SETS ((moves.qtype), ())", "qtype n", "accuracy accuracy_shuffled prediction_agreement mean_max_abs_difference max_abs_difference", **_SHUFFLED),
    "d17_by_gold_other": r(
        "SELECT coalesce(part, 'offering') AS part, count(*) AS n, avg(hit) AS accuracy, avg(said) AS predicted_other_rate FROM (SELECT CASE WHEN labels[gold + 1] = 'other' THEN 'gold_other' ELSE 'gold_named' END AS part, hit, CAST(labels[prediction + 1] = 'other' AS INT) AS said FROM judged_choice WHERE list_contains(labels, 'other')) t GROUP BY GROUPING SETS ((t.part), ())",
        "part n", "accuracy predicted_other_rate",
    ),
    "d18_symmetry": r(
        "SELECT coalesce(kind, 'overall') AS kind, count(*) AS n, avg(probs[1] + negated_p_yes) AS mean_sum, stddev_pop(probs[1] + negated_p_yes) AS std_sum, avg(CAST((probs[1] >= 0.5) <> (negated_p_yes >= 0.5) AS INT)) AS argmax_consistent FROM results_noul GROUP BY GROUPING SETS ((results_noul.kind), ())",
        "kind n", "mean_sum std_sum argmax_consistent",
    ),
    "d19_max_abs_difference": r("SELECT count(*) AS n, CAST(sum(CAST(len(a.probs) <> len(b.probs) AS INT)) AS BIGINT) AS mismatched, max(list_max(list_transform(range(1, len(a.probs) + 1), lambda i: abs(a.probs[i] - b.probs[i])))) AS max_abs_difference FROM results_choice a JOIN run_b b USING (record_id, question_id)", "n mismatched", "max_abs_difference"),
    "d19_timing": r("SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) * 1000 AS median_ms, avg(value) * 1000 AS mean_ms FROM events GROUP BY event_type", "event_type n", "median_ms mean_ms"),
    "d20_split_metrics": r(f"SELECT p.*, ece FROM ({_PROPER.format(by='split, block, name', of='split_rows')}) p JOIN ({ece_sql('split, block, name', 'split_rows')}) e USING (split, block, name)", "split block name n", "accuracy brier nll ece", **_SPLIT_ROWS),
    "d20_split_report": r(_metric_rows(), "split block part metric", "value", **_RUNS, **_TYPED),
    "d21_lines_round_trip": r("SELECT qtype, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(gold) AS BIGINT) AS golds, sum(top1) AS top1 FROM judged GROUP BY qtype", "qtype n hits golds", "top1"),
    "d23_reordered": oracle(
        "SELECT record_id, array_to_string(CASE WHEN drawn = labels AND len(labels) > 1 THEN list_concat(labels[2:], labels[1:1]) ELSE drawn END, ',') AS labels FROM (SELECT record_id, labels, list_transform(list_sort(list_transform(range(1, len(labels) + 1), lambda i: {'d': md5('order:' || CAST(record_id AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)), 'x': labels[i]})), lambda s: s.x) AS drawn FROM results_choice)"
    ),
    "d24_mean_ece": r(f"SELECT avg(ece) AS mean_ece, count(*) AS splits FROM ({ece_sql('split', 'judged_choice')})", "splits", "mean_ece"),
    "d25_pooled_coverage": r(f"SELECT threshold, avg(coverage) AS coverage, CAST(sum(n) AS BIGINT) AS n, sum(accuracy * n) / sum(CASE WHEN n > 0 THEN n END) AS accuracy FROM ({_CURVE.format(by='run', of='all_runs')}) GROUP BY threshold", "n", "threshold coverage accuracy", **_RUNS),
}
