"""Comparison of runs: alignment by hand, contrasts against a plain loop, folders as one table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.operators import comparison as C
from credence.operators.resampling import draw_key, slot_weights
from credence.sources import files

COLUMNS = "run string, split string, record_id long, question_id string, qtype string, gold int, probs array<double>, labels array<string>"
RNG = np.random.default_rng(5)
NAMES = ["base", *[f"v3_x_{a}_n9_s{s}{z}" for a in ("up", "down") for s, z in ((0, ""), (1, ""), (0, "_noisy"))]]


def rows_of(name, n=40):
    out = []
    for i in range(n):
        p = RNG.dirichlet([1, 1, 1])
        out.append((name, "test", i, "q", "choice", i % 3, [float(x) for x in p], ["a", "b", "c"]))
    return out


@pytest.fixture(scope="module")
def data():
    return {name: rows_of(name) for name in NAMES}


@pytest.fixture(scope="module")
def runs(spark, data):
    return spark.createDataFrame([r for rows in data.values() for r in rows], COLUMNS)


def test_alignment_by_hand(spark, data):
    base = data["base"]
    other = lambda name, rows: [(name, *r[1:]) for r in rows]
    rows = base + other("same", base[::-1]) + other("short", base[1:]) + other("twice", [*base, base[3]])
    rows += other("graded", base[:5] + [(*base[5][:5], 2 - base[5][5] or 1, *base[5][6:])] + base[6:]) + other("more", [*base, ("", "test", None, "q", *base[0][4:])])
    rows += [("elsewhere", "valid", *base[0][2:])]
    got = {r["run"]: r.asDict() for r in C.run_alignment(spark.createDataFrame(rows, COLUMNS), "base", ["base", "same", "gone"]).collect()}
    assert {k: v["status"] for k, v in got.items()} == {
        "base": "aligned", "same": "aligned", "short": "misaligned", "twice": "misaligned", "graded": "misaligned", "more": "misaligned", "elsewhere": "no split", "gone": "missing"
    }
    assert (got["short"]["n_missing"], got["twice"]["n_repeated"], got["twice"]["n"], got["graded"]["n_other_gold"], got["more"]["n_extra"]) == (1, 1, 41, 1, 1)
    assert got["same"]["expected"] and got["gone"]["expected"] and not got["short"]["expected"]


def test_repeated_base_is_misaligned(spark, data):
    rows = data["base"] + [data["base"][0]]
    assert [r["status"] for r in C.run_alignment(spark.createDataFrame(rows, COLUMNS), "base", []).collect()] == ["misaligned"]


def test_without_rows(spark):
    empty = spark.createDataFrame([], COLUMNS)
    status = C.run_alignment(empty, "base", ["base"])
    assert status.count() == 0
    assert C.compared_runs(empty, status, {"x": [("up", 9, 0, None, 1)]}, 20, "t").count() == 0


def plain_draws(spark, rows, resamples, seed):
    """Every metric in each resample, by a loop over the records; the plain values first."""
    keys = spark.createDataFrame([(r[2],) for r in rows], "record_id long").select("record_id", draw_key(seed, F.col("record_id")).alias("k")).collect()
    key = {r["record_id"]: r["k"] for r in keys}
    w = np.concatenate([np.ones((len(rows), 1)), slot_weights(np.array([key[r[2]] for r in rows]), resamples)], axis=1)
    out = {m: [] for m in C.METRICS}
    for b in range(w.shape[1]):
        total, hits, brier, nll, bins = 0.0, 0.0, 0.0, 0.0, {}
        for r, x in zip(rows, w[:, b], strict=True):
            p, gold = r[6], r[5]
            hit, top = float(np.argmax(p) == gold), max(p)
            total += x
            hits += x * hit
            brier += x * sum((q - (i == gold)) ** 2 for i, q in enumerate(p))
            nll -= x * np.log(p[gold])
            h, c = bins.get(min(int(top * 15), 14), (0.0, 0.0))
            bins[min(int(top * 15), 14)] = (h + x * hit, c + x * top)
        for m, v in zip(C.METRICS, [hits, sum(abs(h - c) for h, c in bins.values()), brier, nll], strict=True):
            out[m].append(v / total)
    return {m: np.array(v) for m, v in out.items()}


def test_contrasts_equal_a_plain_loop(spark, data, runs):
    status = C.run_alignment(runs, "base", NAMES)
    contrasts = {
        "mean": [("up", 9, None, None, 1), ("down", 9, 0, None, -1)],
        "deltas": [("up", 9, 0, "noisy", 1), ("up", 9, 0, None, -1), ("down", 9, 0, "noisy", -1), ("down", 9, 0, None, 1)],
        "gone": [("up", 9, 0, None, 1), ("sideways", 9, 0, None, -1)],
    }
    got = {(r["contrast"], r["metric"]): r for r in C.compared_runs(runs, status, contrasts, 200, "t").collect()}
    assert len(got) == 12
    d = {name: plain_draws(spark, rows, 200, "t") for name, rows in data.items()}
    run = lambda a, s=0, z="": d[f"v3_x_{a}_n9_s{s}{z}"]
    for m in C.METRICS:
        for name, v in {
            "mean": (run("up")[m] + run("up", 1)[m]) / 2 - run("down")[m],
            "deltas": (run("up", 0, "_noisy")[m] - run("up")[m]) - (run("down", 0, "_noisy")[m] - run("down")[m]),
        }.items():
            r = got[name, m]
            assert np.allclose([r["value"], r["ci_lo"], r["ci_hi"]], [v[0], *np.percentile(v[1:], [2.5, 97.5])], atol=1e-9)
        r = got["gone", m]
        assert (r["n_runs"], r["n_absent"], r["value"], r["ci_lo"]) == (1, 1, None, None)


def test_folders_are_one_table(spark, runs, tmp_path):
    rows = runs.withColumns({"kind": F.lit("k"), "position": F.lit(0), "negated_p_yes": F.lit(None).cast("double"), "cluster": F.col("record_id")})
    path = str(tmp_path / "runs")
    files.write_runs(rows, path)
    back = files.read_runs(spark, path)
    names = COLUMNS.replace(" string", "").replace(" long", "").replace(" int", "").replace(" array<double>", "").replace(" array<string>", "").split(", ")
    assert back.select(names).exceptAll(runs.select(names)).isEmpty() and back.count() == runs.count()
    one = back.where(F.col("run") == "base")
    assert "PartitionFilters: [isnotnull(run" in one._jdf.queryExecution().toString() and one.count() == 40
    with pytest.raises(Exception, match="already exists"):
        files.write_runs(rows, path)


def test_temperatures_add_runs(spark, runs):
    t = spark.createDataFrame([("cold", "base", 1.0), ("hot", "base", 1e9)], "run string, of string, t double")
    got = C.with_temperatures(runs, t)
    assert got.count() == runs.count() + 80
    j = got.where("run = 'cold'").select("record_id", F.col("probs").alias("p")).join(got.where("run = 'base'"), "record_id").join(got.where("run = 'hot'").select("record_id", F.col("probs").alias("h")), "record_id")
    for r in j.collect():
        assert np.allclose(r["p"], r["probs"]) and np.allclose(r["h"], 1 / 3)
