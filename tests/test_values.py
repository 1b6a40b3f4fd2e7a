"""Hand-computed values, invariants and refusals."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credence.functions import distributions as D
from credence.functions import text as T
from credence.functions.draws import uniform
from credence.operators import audit, calibration, construction, feedback, metrics, replies, report, resampling, sampling, text, validation
from credence.plans import fixtures
from credence.sources import files


def results(spark, rows):
    """(record_id, qtype, gold, probs[, labels]) rows as a result table with derived columns."""
    full = [(i, "q", "test", t, "k", 0, g, p, labels or [str(k) for k in range(len(p))], None, i) for i, (t, g, p, labels) in enumerate((*r, None)[:4] for r in rows)]
    return metrics.answers(spark.createDataFrame(full, files.RESULTS))


def one(df, column=0):
    return df.first()[column]


def ranked(spark, pairs):
    return spark.createDataFrame([(i, c, h) for i, (c, h) in enumerate(pairs)], "record_id long, top1 double, hit int").withColumn("all", F.lit(1))


def test_area_by_hand(spark):
    j = ranked(spark, [(0.6, 1), (0.9, 1), (0.5, 0), (0.8, 1), (0.7, 0)])
    assert one(metrics.aurc(j, ["all"]), "aurc") == pytest.approx((0 + 0 + 1 / 3 + 1 / 4 + 2 / 5) / 5)
    assert {r["coverage"] for r in metrics.coverage_at_risk(j, ["all"]).collect()} == {0.4}
    tied = one(metrics.aurc(ranked(spark, [(0.7, 1), (0.7, 0)]), ["all"]), "aurc")
    assert tied == pytest.approx(0.5)


def test_area_with_weights_is_that_of_repeated_rows(spark):
    pairs = [(0.9, 1, 3), (0.8, 0, 2), (0.8, 1, 40), (0.3, 0, 1), (0.2, 1, 5)]
    w = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "record_id long, top1 double, hit int, w int").withColumn("all", F.lit(1))
    again = ranked(spark, [(c, h) for c, h, n in pairs for _ in range(n)])
    assert one(metrics.aurc(w, ["all"], weight=F.col("w")), "aurc") == pytest.approx(one(metrics.aurc(again, ["all"]), "aurc"), abs=1e-12)


def test_harmonic_numbers(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 2, 31, 32, 33, 1000)], "n long").select("n", metrics.harmonic(F.col("n")).alias("h")).collect()
    assert all(r["h"] == pytest.approx(sum(1 / i for i in range(1, r["n"] + 1)), abs=1e-13) for r in got)


def test_predictions_and_confidence(spark):
    j = {r["record_id"]: r for r in results(spark, [("noul", 0, [0.5, 0.5]), ("noul", 0, [0.49, 0.51]), ("choice", 0, [0.5, 0.5, 0.0]), ("score", 2, [0.2, 0.3, 0.5])]).withColumn("e", D.expected_level(F.col("probs"))).collect()}
    assert [j[i]["prediction"] for i in range(4)] == [0, 1, 0, 2]
    assert j[2]["confidence"] == pytest.approx(1 - math.log(2) / math.log(3)) and j[3]["e"] == pytest.approx(1.3)


def test_calibration_error_by_hand(spark):
    rows = [("choice", 0, [0.95, 0.05]), ("choice", 1, [0.95, 0.05]), ("choice", 0, [0.6, 0.4]), ("choice", 0, [1.0, 0.0])]
    j = results(spark, rows)
    # 0.95 and 1.0 share the last of 15 bins; 0.6 has its own
    assert one(metrics.ece(j, ["qtype"]), "ece") == pytest.approx((abs(2 - 2.9) + abs(1 - 0.6)) / 4)
    bins = metrics.reliability(j, ["qtype"]).collect()
    assert len(bins) == 15 and sum(r["count"] for r in bins) == 4 and sum(r["mean_accuracy"] is None for r in bins) == 13
    p = one(metrics.proper_scores(j, ["qtype"]), "brier")
    assert p == pytest.approx((2 * 0.05**2 + 2 * 0.95**2 + 2 * 0.4**2 + 0) / 4)


def test_macro_f1_counts_gold_labels_only(spark):
    j = results(spark, [("choice", 0, [0.9, 0.1, 0.0]), ("choice", 0, [0.1, 0.9, 0.0]), ("choice", 1, [0.1, 0.9, 0.0]), ("choice", 1, [0.0, 0.1, 0.9])])
    assert one(metrics.macro_f1(j, ["qtype"]), "macro_f1") == pytest.approx((2 / 3 + 1 / 2) / 2)


def test_coverage_keeps_the_threshold_itself(spark):
    j = ranked(spark, [(0.5, 1), (0.55, 0)]).withColumn("confidence", F.col("top1"))
    c = {round(r["threshold"], 2): (r["coverage"], r["accuracy"]) for r in metrics.coverage_curve(j, ["all"]).collect()}
    assert c[0.5] == (1.0, 0.5) and c[0.55] == (0.5, 0.0) and c[0.6] == (0.0, None)


def test_prefix_sizes_and_refusals(spark):
    log = spark.range(5000).withColumnRenamed("id", "index")
    for n, train in ((500, 450), (2000, 1800), (5000, 4500)):
        assert feedback.prefix(log, n).where("part = 'train'").count() == train
    for n in (1, 5001):
        with pytest.raises(ValueError):
            feedback.prefix(log, n)


def test_flips_are_nested(spark, small):
    log = fixtures.interactions(spark, small)
    at = lambda rate: {r[0] for r in feedback.reflip(log, 0, rate).where("flipped <> outcome").select("index").collect()}
    assert at(0.1) < at(0.2) < at(0.4) and at(0.2) == {r[0] for r in log.where("flipped <> outcome").select("index").collect()}
    assert one(feedback.log_statistics(log), "propensity_max_abs_diff") <= 1e-6


def test_temperature_keeps_predictions(spark, small):
    r = fixtures.results_choice(spark, small)
    a, b = metrics.answers(r), metrics.answers(calibration.scaled(r, 2.5))
    assert a.join(b.select("record_id", F.col("prediction").alias("other")), "record_id").where("prediction <> other").isEmpty()
    t = one(calibration.fitted(r, "nll", []), "temperature")
    loss = lambda x: one(calibration.losses(r, calibration.nll_loss, [], [x]), "loss")
    assert loss(t) <= min(loss(t * 1.01), loss(t * 0.99)) + 1e-9


def test_slopes_vanish_at_fitted_temperatures(spark, small):
    """Slope of the mean loss at the fit, by plain differences and by the derivatives, for every group and loss."""
    r = fixtures.results(spark, small).select("qtype", "probs", "gold", F.array(F.lit("all"), "qtype").alias("scope"))
    fits = {x["scope"]: x for x in calibration.fitted(r, "nll", ["scope"]).collect()}
    assert set(fits) == {"all", "noul", "choice", "score"}
    for name, x in fits.items():
        own = r.where(F.array_contains("scope", name))
        assert x["n"] == own.count()
        if not calibration.LOW * 1.001 < x["temperature"] < calibration.HIGH * 0.999:
            continue
        t = F.lit(math.log(x["temperature"]))
        assert abs(one(calibration._means(calibration._scores(own, [], "nll"), "nll", t, []), "d1")) < 1e-9
    rng = np.random.default_rng(2)
    for kind in ("nll", "outcome", "theta"):
        size = np.array([1, 2, 5])
        z, x, h = rng.normal(size=8), rng.normal(size=3), 1e-5
        s, o = z[[0, 2, 5]], np.array([1.0, 0.0, 1.0])
        at = lambda d: calibration._derivatives(kind, x + d, z, size, s, o)  # noqa: E731, B023
        assert (at(h)[0] - at(-h)[0]) / (2 * h) == pytest.approx(at(0)[1], abs=1e-6)
        assert (at(h)[1] - at(-h)[1]) / (2 * h) == pytest.approx(at(0)[2], abs=1e-6)


def test_fits_at_the_ends_and_of_nothing(spark):
    sure = spark.createDataFrame([("a", [0.6, 0.4], 0), ("a", [0.7, 0.3], 0), ("b", [0.6, 0.4], 1), ("c", [0.6, 0.4], 0), ("c", [0.6, 0.4], 1), ("d", None, 0), ("d", [], 0)], "g string, probs array<double>, gold int")
    got = {r["g"]: r["temperature"] for r in calibration.fitted(sure, "nll", ["g"]).collect()}
    assert got == {"a": pytest.approx(calibration.LOW), "b": pytest.approx(calibration.HIGH), "c": pytest.approx(calibration.HIGH)}
    assert calibration.fitted(sure.limit(0), "nll", []).count() == 0


def test_inversion_by_hand(spark):
    got = spark.createDataFrame([([0.8, 0.2],), ([0.1, 0.1],), ([0.5, 0.5],)], "p array<double>").select(D.inverted(F.col("p"), 0.2).alias("q")).collect()
    assert got[0]["q"] == pytest.approx([1.0, 0.0]) and got[1]["q"] == [0.1, 0.1] and got[2]["q"] == pytest.approx([0.5, 0.5])


def test_noise_of_the_environment(spark):
    got = [r[0] for r in spark.createDataFrame([(k,) for k in (2, 3, 10, 14, 26)], "k int").select(calibration.eta(F.col("k"))).collect()]
    assert got == pytest.approx([0.05, 0.08, 0.29, 0.40, 0.40])


def test_a_run_has_no_difference_from_itself(spark, small):
    j = metrics.answers(fixtures.results_choice(spark, small))
    w = resampling.multinomial_weights(j, 20, "t")
    r = resampling.paired(j, j, ["qtype"], 20, "t").first()
    assert (r["delta"], r["delta_lo"], r["delta_hi"], r["disagreement"]) == (0, 0, 0, 0)
    n = j.select("record_id").distinct().count()
    assert {x["s"] for x in w.groupBy("b").agg(F.sum("w").alias("s")).collect()} == {n}


def test_slots_are_poisson_and_independent():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 4000)
    w = resampling.slot_weights(keys, 500)
    share = [(w == k).mean() for k in range(6)]
    assert share == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(6)], abs=2e-3)
    assert abs(w.var() - 1) < 0.01 and w.mean(axis=0).std() == pytest.approx(1 / math.sqrt(4000), rel=0.15)
    near = resampling.slot_weights(np.arange(4000), 500)  # keys and slots in a row are as good
    for x in (w, near):
        assert abs(np.corrcoef(x[:, 0], x[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(x[0], x[1])[0, 1]) < 0.15
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.005


def test_slot_sums_equal_a_plain_table(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 40, "ab"[i % 2] if i % 7 else None, float(i)) for i in range(3000)] + [(None, "a", 1.0)], "record_id long, g string, v double").repartition(5)
    keys = {r[0]: r[1] for r in rows.select("record_id", resampling.draw_key("s", F.col("record_id"))).distinct().collect()}
    w = {k: resampling.slot_weights(np.array([x]), 9)[0] for k, x in keys.items()}
    expected = {}
    for r in rows.collect():
        for b in range(-1, 9):
            expected[r["g"], b] = expected.get((r["g"], b), 0) + r["v"] * (1 if b < 0 else w[r["record_id"]][b])
    assert {(r["g"], r["b"]): r["v"] for r in resampling.slot_sums(rows, ["g"], {"v": F.col("v")}, 9, "s").collect()} == pytest.approx(expected)
    plan = resampling.slot_sums(rows, ["g"], {"v": F.col("v")}, 9, "s")._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan  # the sums' own, and the test's repartition


def test_groups_that_a_resample_misses(spark):
    j = spark.createDataFrame([(1, "a", 0, 0.9, 1, 0), (2, "b", 1, 0.6, 0, 1), (3, "b", 1, 0.7, 1, 1)], "record_id long, g string, question_id int, top1 double, hit int, prediction int")
    got = resampling.resampled_metrics(j, ["g"], 50, "s")
    w = got.where("b >= 0").groupBy("g").count().collect()
    assert {r["g"] for r in w} == {"a", "b"} and min(r["count"] for r in w) < 50
    assert resampling.paired(j, j, ["g"], 50, "s").where("delta = 0 and delta_lo = 0").count() == 2


def test_slot_intervals_agree_with_multinomial_ones(spark, small):
    j = metrics.answers(fixtures.results_choice(spark, small))
    slots = resampling.intervals(resampling.resampled_metrics(j, ["qtype"], 1000, "s").where("b >= 0"), ["qtype"]).first()
    drawn = resampling.intervals(resampling.resampled(j, resampling.multinomial_weights(j, 1000, "s"), ["qtype"]), ["qtype"]).first()
    wide = drawn["accuracy_hi"] - drawn["accuracy_lo"]
    for c in ("accuracy_lo", "accuracy_hi", "ece_lo", "ece_hi"):
        assert abs(slots[c] - drawn[c]) < 0.2 * wide


def test_packed_draws_are_the_plain_ones_in_blocks_of_bounded_size(spark, small, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_DRAWS", 2000)
    monkeypatch.setattr(resampling, "TASK_DRAWS", 5000)
    j = metrics.answers(fixtures.results_choice(spark, small)).withColumn("kind", F.when(F.col("record_id") % 3 > 0, F.lit("x")))
    j = j.unionByName(j.where("record_id % 5 = 0"))  # a record may have several rows, and a group no name
    ids = j.select("record_id").unionByName(spark.range(900, 910).select(F.col("id").alias("record_id")))  # or no rows
    plain = resampling.resampled(j, resampling.multinomial_weights(ids, 20, "t"), ["kind"])
    packed = resampling.multinomial_metrics(j, ids, ["kind"], 20, "t")
    rows = lambda df: sorted((str(r["kind"]), r["b"], round(r["accuracy"], 9), round(r["ece"], 9)) for r in df.collect())
    assert rows(packed) == rows(plain) and packed.count() == 40
    draws = resampling.packed_draws(spark, 510, 20, "t", 100).groupBy("block").agg(F.sum(F.octet_length("draws")).alias("bytes")).collect()
    assert sum(r["bytes"] for r in draws) == 4 * 510 * 20 and max(r["bytes"] for r in draws) < 4 * 2500
    assert resampling.multinomial_metrics(j.limit(0), ids.limit(0), ["kind"], 20, "t").count() == 0


def test_dealt_counts_are_those_of_ranked_rows(spark, monkeypatch):
    for name, small in (("PART_ROWS", 16), ("CHUNK", 10), ("HELD_ROWS", 300), ("TASK_ROWS", 2000)):
        monkeypatch.setattr(construction, name, small)
    rng = random.Random(3)
    kinds = [rng.choices((None, "a", "b", "c"), (1, 60, 9, 3))[0] for _ in range(400)]
    rows = [(i, g, rng.choice((None, 0, 1, 2)), rng.choice((None, "x", "y"))) for i, g in enumerate(kinds)]
    df = spark.createDataFrame(rows, "record_id long, source string, cell long, target string")
    many = df.crossJoin(spark.range(1, 5).select(F.col("id").cast("int").alias("b")))
    rank = lambda name: sampling.seeded_rank(many, ["source", "b"], F.md5(F.concat_ws(":", F.lit(f"t:{name}"), "b", "record_id").cast("binary")))
    seat, deal = rank("seat").drop("target"), rank("deal").select(F.col("source").alias("s"), F.col("b").alias("b2"), F.col("rank").alias("r"), "target")
    joined = seat.join(deal, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("b2")) & (F.col("rank") == F.col("r")))
    expected = {tuple(r) for r in joined.groupBy("source", "b", "cell", "target").count().collect()}
    assert {tuple(r) for r in construction.dealt_counts(df, ["source"], 4, "t").collect()} == expected
    assert construction.dealt_counts(df.limit(0), ["source"], 4, "t").isEmpty()


def test_form_queries_measure_texts_once(spark, small):
    from credence import plans

    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("documents.parquet")
    assert [scans(plans.queries()[q](spark, small)) for q in ("b9_form_settings", "b10_form_answers", "b11_form_questions")] == [0, 0, 0]  # stored measures only
    texts = [None, "", " ", "a", " a\u2003b\x85c\x1fd\u200be\t", "\u00a0x\u3000y "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [tuple(r) for r in df.select(T.word_count(F.col("text")), F.size(T.words(F.col("text")))).collect()]
    assert [a for a, _ in got] == [b for _, b in got] == [None, 0, 0, 1, 4, 2]
    rows = spark.createDataFrame([("p", "a, b"), ("p", None), ("p", "a b c"), (None, "1")], "source string, text string")
    plain = text.form_settings(rows, ["source"])
    again = text.form_settings(text.form_measures(rows), ["source"])
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in again.collect()} and plain.count() == 12
    assert one(plain.where("source = 'p' and kind = 'contains_comma'"), "yes_share") == 0.5


def test_pins_move_no_rows(spark, small):
    from credence import plans

    plan = plans.queries()["j6_pin_mismatches"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and plan.count("Exchange") > 0  # only the sums of a task travel


def test_gram_hashes_tell_grams_apart(monkeypatch):
    rng = random.Random(4)
    keys = [" ".join(rng.choice(("a", "b", "ab", "ba1")) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["", "a", "a b c"]
    plain = [(i, " ".join(w[j : j + 3])) for i, w in enumerate(k.split(" ") for k in keys) for j in range(len(w) - 2)]
    which, h = text.gram_hashes([k.encode() for k in keys], 3)
    assert which.tolist() == [i for i, _ in plain]
    assert len({*zip(h.tolist(), (g for _, g in plain), strict=True)}) == len({g for _, g in plain}) == len(set(h.tolist()))
    again = [text.gram_hashes([k.encode()], 3)[1].tolist() for k in keys]
    assert sum(again, []) == h.tolist()  # wherever a gram is
    assert text.gram_hashes([b""], 3)[1].tolist() == []


def test_the_report_reads_its_inputs_once(spark, small):
    from credence import plans

    plan = plans.queries()["d20_split_report"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert small not in plan  # only the stored judged rows
    assert plan.count("+- Exchange") + plan.count(":- Exchange") <= 34


def test_bloom_filter_has_no_false_negatives(spark):
    h = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    words = text.bloom_filter(h.where("h % 4 = 0"), h.where("h % 4 = 0").count())
    passed = {r["h"] for r in text.bloom_passed(h, words).collect()}
    inside = {r["h"] for r in h.where("h % 4 = 0").collect()}
    assert inside <= passed and len(passed - inside) < 0.02 * 20_000
    assert text.bloom_passed(h, text.bloom_filter(h.limit(0), 0)).isEmpty()


def test_overlap_by_hand(spark):
    """Either side may be the one with less text; its filter finds the same rows, and false hits are dropped."""
    line = "one two three four five six seven eight nine ten"
    few = spark.createDataFrame([(1, line), (2, "short text"), (3, None), (4, "a b c d e f g h"), (5, "z " * 9)], "id long, text string")
    many = spark.createDataFrame([(i, f"w{i} " * 3 + "other words that nobody else has here at all") for i in range(200)] + [(900, f"before {line} after"), (901, "short text"), (902, "")], "id long, text string")
    got = text.overlap(few, many).first()
    assert (got["n_test"], got["n_exact"], got["n_overlap"]) == (203, 1, 1)
    got = text.overlap(many, few).first()
    assert (got["n_test"], got["n_exact"], got["n_overlap"]) == (5, 1, 1)
    assert text.overlap(few.limit(0), many).first()["n_overlap"] == 0 and text.overlap(few, many.limit(0)).first()["n_test"] == 0


def test_table_digests_tell_contents_from_layout(spark):
    rows = [(i, f"t{i % 3}", None if i % 4 else "x") for i in range(60)]
    df = spark.createDataFrame(rows, "i long, g string, v string")
    of = lambda x: one(audit.table_digests(x), "digest")
    base = of(df)
    assert base == of(df.orderBy(F.desc("i")).repartition(7)) == of(df.select("v", "i", "g"))
    assert base == one(audit.combined_digest(audit.table_digests(df, ["g"], ["g", "i", "v"])), "digest") == one(audit.combined_digest(audit.table_digests(df, ["v"])), "digest")
    other = [rows[:-1], rows + rows[:1], rows + rows[:2] + rows[:2], [(*rows[0][:2], "y"), *rows[1:]], [(0, "t0", ""), *rows[1:]], rows[1:] + [(0, "x", "t0")]]
    assert len({base, *(of(spark.createDataFrame(x, df.schema)) for x in other)}) == 1 + len(other)
    pins = audit.table_digests(df, ["g"])
    now = audit.table_digests(df.where("g <> 't1'").unionByName(df.where("i = 0")).unionByName(df.limit(1).withColumn("g", F.lit("new"))), ["g"])
    assert {r["g"] for r in audit.pin_mismatches(now, pins, ["g"]).collect()} == {"t0", "t1", "new"}


def test_tables_that_do_not_align_are_refused(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError):
        resampling.aligned(a, a.where("k = 1"), ["k"])
    assert resampling.aligned(a, a, ["k"]).count() == 2


def allocated(spark, sizes, total):
    rows = sampling.allocate(spark.createDataFrame(sorted(sizes.items()), "name string, n long"), total).collect()
    return {r["name"]: r["given"] for r in rows}


def test_allocation(spark):
    assert allocated(spark, {"a": 90, "b": 9, "c": 1}, 10) == {"a": 9, "b": 1, "c": 0}  # one too many: the farthest above its share gives way
    assert allocated(spark, {"a": 60, "b": 26, "c": 14}, 10) == {"a": 6, "b": 3, "c": 1}
    assert sum(allocated(spark, {"a": 1, "b": 1, "c": 1}, 2).values()) == 2
    assert allocated(spark, {"a": 3, "b": 4}, 7) == {"a": 3, "b": 4}


def test_allocation_sums_up(spark):
    rng = random.Random(2)
    for _ in range(25):
        sizes = {f"g{i}": rng.randrange(1, rng.choice([3, 500])) for i in range(rng.randrange(1, 30))}
        total = rng.randrange(1, sum(sizes.values()) + 1)
        got = allocated(spark, sizes, total)
        assert sum(got.values()) == total and all(0 <= got[k] <= sizes[k] for k in sizes)


def test_ranks_are_complete_under_skew(spark):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 10 < 9, "hot").alias("g"))
    r = sampling.seeded_rank(df, ["g"], F.md5(F.col("id").cast("string").cast("binary")))
    got = r.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m")).collect()
    assert all(x["n"] == x["d"] == x["m"] for x in got)


def test_nobody_is_asked_its_own_label(spark):
    even = F.concat(F.lit("l"), (F.col("id") % 8).cast("string"))
    uneven = F.concat(F.lit("l"), (F.sqrt("id") % 7).cast("int").cast("string"))
    half = F.when(F.col("id") % 2 == 0, "l1").otherwise(F.concat(F.lit("m"), (F.col("id") % 6).cast("string")))
    two = F.when(F.col("id") < 500, "l1").otherwise("l2")
    for n, label in ((4000, even), (999, uneven), (1000, half), (1000, two), (2, F.col("id").cast("string"))):
        rows = spark.range(n).select(F.col("id").alias("record_id"), label.alias("intent"))
        got = sampling.matched_asks(rows, "intent", "record_id", "t").cache()
        assert got.count() == n and got.where("asked = intent or asked is null").isEmpty()
        count = lambda c: {r[0]: r[1] for r in got.groupBy(c).count().collect()}
        assert count("asked") == count("intent")
        if label is even:  # what is asked says little of the label: each other one is asked about as often
            cells = got.groupBy("intent", "asked").count().collect()
            assert len(cells) == 56 and max(r["count"] for r in cells) < 2 * 4000 / 56
        got.unpersist()
    with pytest.raises(ValueError):
        sampling.matched_asks(rows.where("intent = '1'"), "intent", "record_id", "t")


def test_leading_ranks_are_those_of_all_ranks(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    order = F.md5(F.col("id").cast("string").cast("binary"))
    for by in ([], ["g"]):
        whole = sampling.seeded_rank(df, by, order).where("rank <= 40")
        some = sampling.seeded_rank(df, by, order, upto=40)
        fine = sampling.seeded_rank(df, by, order, upto=40, rows=10**10)
        assert sorted(whole.collect()) == sorted(some.collect()) == sorted(fine.collect())


def test_duplicates_by_hand(spark):
    rows = spark.createDataFrame([(1, "Hello, World"), (2, "hello world!"), (3, "other"), (4, "kept"), (5, ""), (6, "!?")], "i long, text string")
    out = spark.createDataFrame([("OTHER",)], "text string")
    got = {r["index"]: (r["reason"], r["first_kept"]) for r in text.dedupe(rows, text.excluded_keys(out), "i").collect()}
    assert got == {1: ("kept", None), 2: ("repeat", 1), 3: ("test_text", None), 4: ("kept", None), 5: ("kept", None), 6: ("repeat", 5)}


def test_overlap_needs_eight_words(spark):
    ref = spark.createDataFrame([(1, "a b c d e f g h i")], "id long, text string")
    test = spark.createDataFrame([(1, "x b c d e f g h i y"), (2, "a b c d e f g"), (3, "A, b c d e f g h i!")], "id long, text string")
    r = text.overlap(ref, test).first()
    assert (r["n_exact"], r["n_overlap"]) == (1, 2)


def test_compatibility_forms(spark):
    texts = {"ﬁne ①": "fine 1", "ﬁne ＡＢ": "fine ab", "ｆｕｌｌ ｗｉｄｔｈ": "full width", "cafe\u0301 é": "caf", "ÀB": "b", "plain": "plain", "": ""}
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", T.normalise(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in rows} == texts | {None: None}


def test_words_end_at_any_white_space(spark):
    t = "a\u00a0b\u3000c\u2003d\x1ce\u200bf?\u00a0"
    row = spark.createDataFrame([(t,)], "t string").select(T.words(F.col("t")), T.FORM_KINDS["ends_with_question_mark"](F.col("t"))).first()
    assert row[0] == t.split() and row[1] == 1


def test_thresholds_by_hand(spark):
    v = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 5), ("b", 5)], "g string, value long")
    got = {r["g"]: (r["threshold"], r["yes_share"]) for r in text.best_threshold(v, ["g"]).collect()}
    assert got == {"a": (2, 0.5), "b": (4, 1.0)}


def test_templates_round_trip(spark):
    t = text.template_table(spark)
    shown = t.select(F.monotonically_increasing_id().alias("id"), "kind", "template", "negated", text.render(F.col("pattern"), F.lit("some thing")).alias("instructions"))
    back = text.parse(shown.select("id", "kind", "instructions")).join(shown.select("id", F.col("template").alias("t"), F.col("negated").alias("n")), "id")
    assert back.count() == t.count() and back.where("template <> t or negated <> n").isEmpty()
    twice = text.negate(text.parse(text.negate(text.parse(shown.select("id", "kind", "instructions")))))
    assert twice.join(shown.select("id", F.col("instructions").alias("was")), "id").where("instructions <> was").isEmpty()


def test_gate_finds_an_injected_leak(spark):
    rows = spark.createDataFrame([(i, "k", i % 2 == 0, 0, i % 2 == 0, True) for i in range(200)], "record_id long, kind string, underlying boolean, template int, negated boolean, gold boolean")
    assert one(construction.phrasing_report(rows), "phrasing_only_accuracy") == 1.0
    lifts = spark.createDataFrame([("a", 0.2), ("b", 0.05), ("c", 0.01)], "g string, lift double")
    nulls = spark.createDataFrame([(g, x / 1000) for g in "abc" for x in range(40)], "g string, lift double")
    assert {r["g"]: r["fails"] for r in construction.lift_gate(lifts, nulls, ["g"]).collect()} == {"a": True, "b": True, "c": False}


def test_wilson_and_kappa(spark):
    r = spark.createDataFrame([(5, 10), (0, 0)], "k long, n long").select(audit.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert (r[0]["w"]["lo"], r[0]["w"]["hi"]) == pytest.approx((0.2366, 0.7634), abs=1e-4) and (r[1]["w"]["lo"], r[1]["w"]["hi"]) == (0, 0)
    rows = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15, "x string, y string").withColumn("g", F.lit(1))
    assert one(audit.kappa(rows, ["g"], "x", "y"), "kappa") == pytest.approx(0.4)
    assert one(audit.kappa(rows.where("x = 'a' and y = 'a'"), ["g"], "x", "y"), "kappa") is None


def test_existing_output_is_refused(spark, tmp_path):
    df = spark.range(3)
    files.write_lines(df, str(tmp_path / "x"))
    with pytest.raises(Exception, match="already exists"):
        files.write_lines(df, str(tmp_path / "x"))
    files.append_lines(df, str(tmp_path / "x"))
    assert files.read_lines(spark, str(tmp_path / "x"), "id long, later string").where("later is null").count() == 6
    (tmp_path / "bad.json").write_text('{"id": "text"}\n')
    with pytest.raises(Exception):
        files.read_lines(spark, str(tmp_path / "bad.json"), "id long").collect()


def test_other_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", "x"), (2, None, "y")], "id long, note string, split string")
    files.write_table(df, str(tmp_path / "csv"))
    assert sorted(files.read_table(spark, str(tmp_path / "csv"), "id long, note string, split string").collect()) == sorted(df.collect())
    files.write_by_split(df, str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).where("split = 'x'").count() == 1
    for name in ("v3_06b_arm_n500_s1", "other"):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "metrics.json").write_text("{}")
    got = {r["run"]: (r["n"], r["seed"]) for r in files.run_names(spark, str(tmp_path / "runs")).collect()}
    assert got == {"v3_06b_arm_n500_s1": (500, 1), "other": (None, None)}


def test_last_reply_wins_and_keys_are_strict(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b")], "k long, i long, v string")
    assert [tuple(r) for r in replies.last_wins(rows, ["k"], "i").collect()] == [(1, 3, "c")]
    bodies = ['{"a": 1}', '{"a": 1, "a": 1}', '{"a": {"b": 1, "b": 2}}', "x"]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(validation.repeated_keys(F.col("b"))).collect()]
    assert got == [False, True, True, True]


def test_state_rendering(spark):
    rows = ['{"a": "é", "b": [1, 2]}', '"plain"', "3", "NaN", "{", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(validation.render_state(F.col("s"))).collect()]
    assert got == ['{\n  "a": "é",\n  "b": [\n    1,\n    2\n  ]\n}', "plain", None, None, None, None]


def test_budget_stops_before_the_cap(spark):
    rows = spark.createDataFrame([("r", i, 1.0) for i in range(10)], "run string, i int, cost double")
    assert replies.within_budget(rows, "run", "i", "cost", 4.5).count() == 4


def test_draws_are_uniform(spark):
    u = spark.range(20_000).select(uniform("s", F.col("id")).alias("u")).agg(F.avg("u"), F.var_pop("u"), F.min("u"), F.max("u")).first()
    assert abs(u[0] - 0.5) < 0.01 and abs(u[1] - 1 / 12) < 0.003 and 0 <= u[2] and u[3] < 1


def test_sources_without_a_subpackage(tmp_path):
    """The rest imports and registers its queries when the corpus part is gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "credence", tmp_path / "credence", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    (tmp_path / "credence" / "llm" / "__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.mark.parametrize("arm", feedback.ARMS)
def test_logit_gradients_equal_a_plain_loop(spark, arm):
    """Loss and gradient of each question by a loop, and the loss's differences as it is moved."""
    rng = np.random.default_rng(4)
    ps = {i: [float(x) for x in rng.dirichlet([1] * (2 + i % 3))] for i in range(12)}
    q = spark.createDataFrame([(i, "q", "choice", i % 2, p) for i, p in ps.items()], "record_id long, question_id string, qtype string, gold int, probs array<double>")
    draws = feedback.group_draws(q, 5, 0.1, "t")
    acts = {}
    for r in draws.collect():
        acts.setdefault(r["record_id"], []).append(r)
    for r in feedback.logit_gradients(q, draws, arm).collect():
        p, mine = np.array(ps[r["record_id"]]), acts[r["record_id"]]
        a, pa, hit = np.array([x["action"] for x in mine]), np.array([x["p"] for x in mine]), np.array([float(x["r"]) for x in mine])
        reward = {"outcome": hit, "outcome_minus_p": hit - pa, "brier": 1 - (hit - pa) ** 2, "log": np.log(np.where(hit == 1, pa, 1 - pa))}[arm]
        aw = (reward - reward.mean()) * np.minimum(pa / (0.9 * pa + 0.1 / len(p)), 5.0)
        assert r["loss"] == pytest.approx(-(aw * np.log(pa)).mean(), abs=1e-9)
        want = [-(aw * ((a == j) - p[j])).mean() for j in range(len(p))]
        assert np.allclose(r["gradient"], want, atol=1e-9) and np.allclose(r["by_difference"], want, atol=1e-6)
    row = feedback.gradient_check(feedback.logit_gradients(q, draws, arm), arm).first()
    assert row["questions"] == 12 and row["matches"] and row["sums_to_zero"]
    wrong = feedback.logit_gradients(q, draws, arm).withColumn("gradient", F.transform("gradient", lambda x: x + 1e-3))
    assert not feedback.gradient_check(wrong, arm).first()["matches"]


def test_logs_say_how_they_were_drawn(spark, tmp_path):
    log = spark.createDataFrame([(0, 1, "q", ["a", "b"], [0.5, 0.5], 0, 0.5, 1, 0), (1, 2, "q", ["a", "b"], [0.5, 0.5], 1, 0.5, 0, 0)], files.LOG)
    folder = str(tmp_path / "logs")
    files.write_log(log, folder, "told", {"seed": 7, "flip_rate": 0.4}, {"noise": "soft"})
    files.write_log(log.limit(1), folder, "older", {"seed": 3})
    files.write_log(log.limit(1), folder, "untold", None)
    got = {r["log"]: tuple(r)[1:] for r in files.read_log_metadata(spark, folder).collect()}
    assert got == {"told": (2, 1, True, 7, 0.4, "soft"), "older": (1, 1, True, 3, 0.2, None), "untold": (1, 1, False, None, None, None)}
    assert files.read_logs(spark, folder).where("log = 'told'").count() == 2
    with pytest.raises(Exception, match="already exists"):
        files.write_log(log, folder, "told", {"seed": 7})


def test_report_rows_by_hand(spark):
    block = "run string, split string, n long, metric string, value double"
    have = spark.createDataFrame([("m", "test", 10, "accuracy", 0.5), ("both", "test", 10, "accuracy", 0.6)], block)
    told = spark.createDataFrame([("api", "test", 9, "accuracy_all", 0.4), ("api", "valid", 9, "accuracy_all", 0.3), ("both", "test", 10, "accuracy_all", 0.1)], block)
    feet = spark.createDataFrame([("m", "temperature", 1.5)], "run string, metric string, value double")
    got = sorted(map(tuple, report.report_rows(have, told, feet, ["m", "api", "gone"]).collect()), key=str)
    assert got == sorted([
        ("m", "results", "test", "accuracy", 0.5, 10, False), ("both", "results", "test", "accuracy", 0.6, 10, False), ("api", "replies", "test", "accuracy_all", 0.4, 9, True),
        ("api", "replies", "valid", "accuracy_all", 0.3, 9, False), ("gone", "missing", None, None, None, None, None), ("m", "footer", None, "temperature", 1.5, None, None),
        ("api", "footer", None, None, None, None, None), ("gone", "footer", None, None, None, None, None),
    ], key=str)
