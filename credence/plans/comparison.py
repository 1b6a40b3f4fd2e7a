"""Queries that compare the runs of a folder, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from credence.functions import distributions as D
from credence.operators import comparison as C
from credence.plans import fixtures as X
from credence.plans.fixtures import oracle, sql_slots, sql_softmax
from credence.plans.metrics import rounded
from credence.session import shared_folder
from credence.sources import files

RESAMPLES = 1000
BASE = "v3_06b_zeroshot_n0_s0"
ARMS = ["direct_brier", "positive_sft", "full_sft"]
PAIRS = [("direct_brier", "positive_sft"), ("direct_brier", "full_sft")]
#: Runs of the fixture: the shares of the three models whose answers are mixed.
MIXED = {
    BASE: (0.0, 1.0, 0.0),
    "v3_06b_direct_brier_n500_s0": (0.5, 0.5, 0.0),
    "v3_06b_direct_brier_n5000_s0": (1.0, 0.0, 0.0),
    "v3_06b_direct_brier_n5000_s1": (0.8, 0.2, 0.0),
    "v3_06b_direct_brier_n5000_s2": (0.7, 0.0, 0.3),
    "v3_06b_direct_brier_n5000_s0_noisy": (0.3, 0.7, 0.0),
    "v3_06b_positive_sft_n500_s0": (0.0, 0.5, 0.5),
    "v3_06b_positive_sft_n5000_s0": (0.0, 0.0, 1.0),
    "v3_06b_positive_sft_n5000_s1": (0.2, 0.0, 0.8),
    "v3_06b_positive_sft_n5000_s0_noisy": (0.0, 0.7, 0.3),
    "v3_06b_full_sft_n5000_s0": (0.6, 0.0, 0.4),
    "v3_06b_full_sft_n5000_s1": (0.5, 0.1, 0.4),
    "v3_06b_scratch_n1_s0": (0.1, 0.0, 0.9),
}
LOST, REGRADED, UNEXPECTED, ABSENT = "v3_06b_full_sft_n5000_s1", "v3_06b_positive_sft_n5000_s1", "v3_06b_scratch_n1_s0", "v3_06b_full_sft_n500_s0"
EXPECTED = [*[n for n in MIXED if n != UNEXPECTED], ABSENT, "v3_06b_direct_brier_temp_n5000_s0"]
#: A run whose answers are another's at a temperature.
SCALED, OF, T = "v3_06b_direct_brier_temp_n5000_s0", "v3_06b_direct_brier_n5000_s0", 1.5
CONTRASTS = C.learner_contrasts("zeroshot", [*ARMS, "direct_brier_temp"], [500, 5000], [*PAIRS, ("direct_brier_temp", "direct_brier")], 5000)


def written(s, d):
    """Runs written to a folder and found there again. One has lost some records and repeats others, one
    has other gold answers in a split, one was not expected and one is absent."""
    b = X.results_choice(s, d, 1.0).select("record_id", F.col("probs").alias("pb"))
    c = X.results_choice(s, d, 0.05, 0.15).select("record_id", F.col("probs").alias("pc"))
    dim = F.array(*[F.struct(F.lit(run).alias("run"), *[F.lit(w).alias(f"w{i}") for i, w in enumerate(ws)]) for run, ws in MIXED.items()])
    each = X.results_choice(s, d).join(b, "record_id").join(c, "record_id").select("*", F.inline(dim))
    mixed = lambda x, y, z: F.round(F.col("w0") * x + F.col("w1") * y + F.col("w2") * z, 9)
    three = F.arrays_zip(F.col("probs").alias("a"), F.col("pb").alias("b"), F.col("pc").alias("c"))
    each = each.withColumn("probs", F.transform(three, lambda p: mixed(p["a"], p["b"], p["c"])))
    copies = F.when((F.col("run") == LOST) & (F.col("record_id") % 50 == 1), 0).when((F.col("run") == LOST) & (F.col("record_id") % 50 == 2), 2).otherwise(1)
    regraded = (F.col("run") == REGRADED) & (F.col("record_id") % 40 == 4)
    each = each.withColumn("gold", F.when(regraded, (F.col("gold") + 1) % F.size("labels")).otherwise(F.col("gold")))
    folder = f"{shared_folder(s)}/runs-{uuid.uuid4().hex}"
    files.write_runs(each.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*X.COLUMNS, "run"), folder)
    scaled = s.createDataFrame([(SCALED, OF, T)], "run string, of string, t double")
    return C.with_temperatures(files.read_runs(s, folder), scaled)


def alignment(s, d):
    return C.run_alignment(written(s, d), BASE, EXPECTED)


def contrasts(s, d):
    runs = written(s, d)
    return rounded(C.compared_runs(runs, C.run_alignment(runs, BASE, EXPECTED), CONTRASTS, RESAMPLES, "e11"))


QUERIES = {"e11_run_alignment": alignment, "e11_run_contrasts": contrasts}

_DIM = ", ".join(f"('{run}', {a}, {b}, {c})" for run, (a, b, c) in MIXED.items())
_PARTS = " UNION ALL ".join(
    f"SELECT '{name}' AS contrast, {i} AS term, '{arm}' AS arm, {n} AS n, {'NULL' if seed is None else seed} AS seed, '{noise or ''}' AS noise, {float(f)} AS factor"
    for name, terms in CONTRASTS.items() for i, (arm, n, seed, noise, f) in enumerate(terms)
)
_TEMPERED = sql_softmax(f"list_transform(probs, lambda x: ln(greatest(x, 1e-45)) / {T})")
_FX = {
    "mixed_runs": f"""
    SELECT a.record_id, a.split, a.labels, run, CASE WHEN run = '{REGRADED}' AND a.record_id % 40 = 4 THEN CAST((a.gold + 1) % len(a.labels) AS INT) ELSE a.gold END AS gold,
      list_transform(range(1, len(a.probs) + 1), lambda i: round(w0 * a.probs[i] + w1 * b.probs[i] + w2 * c.probs[i], 9)) AS probs
    FROM results_choice a JOIN run_b b USING (record_id) JOIN run_c c USING (record_id), (VALUES {_DIM}) AS dim(run, w0, w1, w2)""",
    "found_runs": f"""
    SELECT * FROM mixed_runs WHERE NOT (run = '{LOST}' AND record_id % 50 = 1) UNION ALL SELECT * FROM mixed_runs WHERE run = '{LOST}' AND record_id % 50 = 2
    UNION ALL SELECT record_id, split, labels, '{SCALED}', gold, {_TEMPERED} FROM mixed_runs WHERE run = '{OF}'""",
    "run_keys": f"""
    SELECT n.run, b.split, b.gold AS base_gold, f.record_id AS found, f.gold FROM (SELECT DISTINCT run FROM found_runs UNION SELECT unnest({EXPECTED})) n, (SELECT * FROM found_runs WHERE run = '{BASE}') b
    LEFT JOIN found_runs f ON f.run = n.run AND f.record_id = b.record_id""",
    "run_status": f"""
    SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN n_missing + n_extra + n_repeated + n_other_gold > 0 THEN 'misaligned' ELSE 'aligned' END AS status FROM (
      SELECT run, split, run IN (SELECT unnest({EXPECTED})) AS expected, CAST((SELECT count(*) FROM results_choice c WHERE c.split = k.split) AS BIGINT) AS n_base, count(found) AS n, count(*) FILTER (WHERE found IS NULL) AS n_missing, CAST(0 AS BIGINT) AS n_extra,
        count(found) - count(DISTINCT found) AS n_repeated, count(*) FILTER (WHERE gold <> base_gold) AS n_other_gold FROM run_keys k GROUP BY run, split)""",
    "aligned_runs": """
    SELECT f.*, CAST(list_position(probs, list_max(probs)) - 1 = gold AS INT) AS hit, list_max(probs) AS top1,
      list_sum(list_transform(range(len(probs)), lambda i: pow(probs[i + 1] - CASE WHEN i = gold THEN 1 ELSE 0 END, 2))) AS brier, -ln(greatest(probs[gold + 1], 1e-12)) AS nll
    FROM found_runs f JOIN run_status s USING (run, split) WHERE s.status = 'aligned'""",
    "slots": sql_slots(RESAMPLES, "e11", "results_choice"),
    "slot_values": """
    SELECT run, split, b, unnest(['accuracy', 'ece', 'brier', 'nll']) AS metric, unnest([sum(h) / sum(w), sum(abs(h - c)) / sum(w), sum(s) / sum(w), sum(l) / sum(w)]) AS value FROM (
      SELECT run, split, b, least(CAST(floor(top1 * 15) AS INT), 14) AS bin, sum(w) AS w, sum(w * hit) AS h, sum(w * top1) AS c, sum(w * brier) AS s, sum(w * nll) AS l
      FROM aligned_runs JOIN (SELECT record_id, b, w FROM slots UNION ALL SELECT record_id, -1, 1 FROM results_choice) USING (record_id) GROUP BY ALL) GROUP BY run, split, b""",
    "wanted_terms": _PARTS,
    "answering": r"""
    SELECT t.contrast, s.split, t.term, r.run, t.factor / greatest(count(r.run) OVER (PARTITION BY t.contrast, s.split, t.term), 1) AS factor
    FROM wanted_terms t CROSS JOIN (SELECT DISTINCT split FROM results_choice) s LEFT JOIN (
      SELECT split, run, regexp_extract(run, '^v3_06b_(.+)_n\d+_s', 1) AS arm, CAST(regexp_extract(run, '_n(\d+)_s', 1) AS INT) AS n, CAST(regexp_extract(run, '_s(\d+)', 1) AS INT) AS seed, CASE WHEN run LIKE '%noisy' THEN 'noisy' ELSE '' END AS noise
      FROM run_status WHERE status = 'aligned') r ON r.split = s.split AND r.arm = t.arm AND r.n = t.n AND r.noise = t.noise AND coalesce(t.seed, r.seed) = r.seed""",
}

_WHOLE = "SELECT contrast, split, count(run) AS n_runs, count(*) - count(run) AS n_absent, unnest(['accuracy', 'ece', 'brier', 'nll']) AS metric FROM answering GROUP BY contrast, split"
_DRAWN = "SELECT contrast, split, metric, b, sum(value * factor) AS d FROM answering JOIN slot_values USING (run, split) GROUP BY ALL"
_VALUES = f"SELECT contrast, split, metric, max(d) FILTER (WHERE b < 0) AS value, quantile_cont(d, 0.025) FILTER (WHERE b >= 0) AS ci_lo, quantile_cont(d, 0.975) FILTER (WHERE b >= 0) AS ci_hi FROM ({_DRAWN}) GROUP BY ALL"


def _sql(body: str) -> str:
    from credence.plans.metrics import _RUNS

    return oracle(body, **_RUNS, **_FX)


ORACLES = {
    "e11_run_alignment": _sql("SELECT * FROM run_status"),
    "e11_run_contrasts": _sql(f"""SELECT contrast, split, metric, n_runs, n_absent, {", ".join(f"CASE WHEN n_absent = 0 THEN round({v}, 6) END AS {v}" for v in ("value", "ci_lo", "ci_hi"))}
    FROM ({_WHOLE}) w LEFT JOIN ({_VALUES}) v USING (contrast, split, metric)"""),
}
