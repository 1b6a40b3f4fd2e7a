"""Leak probes: all models fitted at once against a plain loop of single fits."""

import numpy as np
import pytest

from credence.operators import construction, probes

SCHEMA = "record_id long, part string, t string, features array<string>"


def made(n=260, parts=("x", "y"), seed=3):
    """Rows whose target hangs weakly on some features, in unequal groups with three targets."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        part = parts[0] if i % 3 else parts[-1]
        f = [f"w{j}" for j in rng.choice(9, size=rng.integers(0, 5), replace=False)]
        t = "abc"[int(rng.integers(3))] if rng.random() < 0.6 else "abc"[("w1" in f) + ("w2" in f) * ("w3" in f)]
        rows.append((i, part, t, f))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


def plain_permutation(place, n, b):
    top = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & top
        x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & top
        return x ^ (x >> 33)

    for r in range(probes.SWAPS):
        key = mixed(mixed(b + 1) + r & top)
        other = (key % n - place) % n
        if b and mixed((max(place, other) + key) & top) >> 63:
            place = other
    return place


def plain_softmax(m):
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def plain_tree(x, g, h, rows, depth):
    """One regression tree, grown node by node: a function from rows to values."""
    G, H = g[rows].sum(), h[rows].sum()
    value = -probes.RATE * G / (H + 1)
    if not depth:
        return lambda r: value
    best, gain = None, 0
    for j in range(x.shape[1]):
        yes = rows & (x[:, j] > 0)
        no = rows & (x[:, j] == 0)
        if yes.sum() < probes.LEAST or no.sum() < probes.LEAST:
            continue
        score = round(float(sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (yes, no)) - G**2 / (H + 1)), 6)
        if score > gain:
            best, gain = j, score
    if best is None:
        return plain_tree(x, g, h, rows, depth - 1)
    yes = plain_tree(x, g, h, rows & (x[:, best] > 0), depth - 1)
    no = plain_tree(x, g, h, rows & (x[:, best] == 0), depth - 1)
    return lambda r: yes(r) if r[best] else no(r)


def plain_boosting(x, y, train, k):
    m = np.zeros((len(y), k))
    for _ in range(probes.ROUNDS):
        p = plain_softmax(m)
        trees = [plain_tree(x, p[:, c] - (y == c), p[:, c] * (1 - p[:, c]), train, probes.DEPTH) for c in range(k)]
        m += np.array([[t(r) for t in trees] for r in x])
    return m


def plain_logistic(x, y, train, k):
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    pace = 1 / (0.5 * x1.sum(axis=1).max() * x1.sum(axis=0) + probes.RIDGE)
    w = before = np.zeros((x1.shape[1], k))
    for t in range(probes.STEPS):
        v = w + t / (t + 3) * (w - before)
        slope = x1[train].T @ (plain_softmax(x1[train] @ v) - np.eye(k)[y[train]])
        before, w = w, v - pace[:, None] * (slope + probes.RIDGE * v)
    return x1 @ w


def plain_accuracy(table, group, b, model):
    """Accuracy of one shuffle by fits on the rows, a fold at a time."""
    table = sorted(table, key=lambda r: r["place"])
    x = np.zeros((group.n, group.columns))
    for r in table:
        x[r["place"], r["x"]] = 1
    if model == "boosting":
        x = x[:, : probes.COLUMNS]
    upto = np.cumsum(group.counts)
    y = np.array([r["y"] if not b else int(np.searchsorted(upto, plain_permutation(r["place"], group.n, b), side="right")) for r in table])
    assert sorted(y) == sorted(r["y"] for r in table)  # a shuffle keeps the counts
    fit, fold, hits = plain_boosting if model == "boosting" else plain_logistic, np.arange(group.n) % probes.FOLDS, 0
    for f in range(probes.FOLDS):
        m = fit(x, y, fold != f, len(group.targets))
        hits += int((np.argmax(np.round(m, 9), axis=1) == y)[fold == f].sum())
    return hits / group.n


@pytest.mark.parametrize("model", probes.MODELS)
def test_all_fits_at_once_equal_a_plain_loop(spark, rows, model):
    table, groups = probes.prepared(rows, ["part"], "t")
    assert {g: (x.n, x.targets) for g, x in groups.items()} == {"x": (173, ("a", "b", "c")), "y": (87, ("a", "b", "c"))}
    shuffles = [0, 1, 2, 30]
    got = {(r["g"], r["b"]): r for r in probes.probe_lifts(rows, ["part"], "t", (model,), shuffles=shuffles).collect()}
    held = table.collect()
    for g, group in groups.items():
        for b in shuffles:
            expected = plain_accuracy([r for r in held if r["g"] == g], group, b, model)
            assert got[g, b]["accuracy"] == pytest.approx(expected, abs=1e-12), (g, b)
            assert got[g, b]["lift"] == pytest.approx(expected - max(group.counts) / group.n, abs=1e-8)


def test_blocks_of_shuffles_do_not_matter(spark, rows, monkeypatch):
    shuffles = list(range(0, 7))
    one = sorted(map(tuple, probes.probe_lifts(rows, ["part"], "t", ("boosting",), shuffles=shuffles).collect()))
    monkeypatch.setattr(probes, "BLOCK", 3)
    probed = sorted(map(tuple, probes.probe_lifts(rows.coalesce(1), ["part"], "t", ("boosting",), shuffles=shuffles).collect()))
    assert one == probed and len(one) == 2 * 7


def test_cells_are_packed_in_as_few_parts_as_they_need(spark, rows):
    table, groups = probes.prepared(rows, ["part"], "t")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        got = probes.cells(table, groups, [0, 5], None)
        assert got.rdd.getNumPartitions() <= 8  # a pass has so many tasks; 64 before
        packed, each = got.collect(), table.collect()
        assert probes.cells(table, groups, list(range(2000)), None).rdd.getNumPartitions() == 6  # 520,000 rows shuffled
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    expected = {(r["g"], r["place"] % probes.FOLDS, tuple(r["x"])) for r in each}
    found = []
    for r in packed:
        fold, sizes, x = (np.frombuffer(r[c], dtype=np.int32) for c in ("folds", "sizes", "x"))
        lists = np.split(x, np.cumsum(sizes)[:-1])
        found += [(r["g"], int(f), tuple(v.tolist())) for f, v in zip(fold, lists, strict=True)]
        counts = np.frombuffer(r["counts"], dtype=np.int64).reshape(len(fold), 2, -1)
        assert (counts.sum(axis=2)[:, 0] == counts.sum(axis=2)[:, 1]).all()  # a shuffle moves no row
    assert len(found) == len(set(found)) and set(found) == expected
    assert len(packed) < len(found) / 4  # rows of many cells, not a row a cell
    for g, group in groups.items():
        counts = sum(np.frombuffer(r["counts"], dtype=np.int64).reshape(-1, 2, len(group.targets)).sum(axis=0) for r in packed if r["g"] == g)
        assert counts.tolist() == [list(group.counts)] * 2


@pytest.mark.parametrize("model", probes.MODELS)
def test_small_packs_do_not_matter(spark, rows, monkeypatch, model):
    def probed():
        return sorted(map(tuple, probes.probe_lifts(rows, ["part"], "t", (model,), shuffles=list(range(4))).collect()))

    one = probed()
    for name, least in (("PACKED", 3), ("FEWEST", 3), ("HELD", 40), ("SLICE", 16), ("BLOCK", 3)):
        monkeypatch.setattr(probes, name, least)
    assert probed() == one and len(one) == 2 * 4


def test_partial_sums_are_added_up_where_the_cells_are(monkeypatch):
    terms = [("a", 0), ("a", 1), ("a", 0), ("a", 1), ("b", 0), ("b", 0), ("a", 0)]

    def summed():
        got = [b.to_pylist()[0] for b in probes._summed((g, k, np.full(3, 2.0**i)) for i, (g, k) in enumerate(terms))]
        return [(r["g"], r["block"], np.frombuffer(r["sums"])[0]) for r in got]

    assert summed() == [("a", 0, 5), ("a", 1, 10), ("b", 0, 48), ("a", 0, 64)]
    monkeypatch.setattr(probes, "SUMMED", 5)  # one block at a time
    assert summed() == [("a", 0, 1), ("a", 1, 2), ("a", 0, 4), ("a", 1, 8), ("b", 0, 48), ("a", 0, 64)]


def test_permutations():
    for n in (1, 2, 3, 10, 97):
        got = probes.permuted(np.arange(n), n, np.arange(12))
        assert (np.sort(got, axis=1) == np.arange(n)).all() and (got[0] == np.arange(n)).all()
        assert got.tolist() == [[plain_permutation(i, n, b) for i in range(n)] for b in range(12)]
    # each place goes everywhere about equally often
    many = probes.permuted(np.arange(5), 5, np.arange(1, 8001))
    shares = np.stack([(many == k).mean(axis=0) for k in range(5)])
    assert np.abs(shares - 0.2).max() < 0.02


def test_probes_use_all_features_and_interactions(spark):
    # 300 common features say nothing; a rare one for each row of class a, and an interaction for the trees
    rows = [(i, "p", "a" if i % 2 else "b", [f"n{j}" for j in range(300)] + [f"leak{i % 6}"]) for i in range(240)]
    got = {r["model"]: r["accuracy"] for r in probes.probe_lifts(spark.createDataFrame(rows, SCHEMA), ["part"], "t").collect()}
    assert got["logistic"] == 1 and got["boosting"] < 0.7  # the trees see the most frequent columns only
    rng = np.random.default_rng(1)
    pairs = [(i, "p", "ab"[int(u) ^ int(v)], [f"x{int(u)}", f"y{int(v)}"]) for i, (u, v) in enumerate(rng.integers(0, 2, (400, 2)))]
    got = {r["model"]: r["accuracy"] for r in probes.probe_lifts(spark.createDataFrame(pairs, SCHEMA), ["part"], "t").collect()}
    assert got["boosting"] > 0.95 and got["logistic"] < 0.8


def test_gate_by_group(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        part, t = "abc"[i % 3], int(rng.integers(2))
        tell = {"a": 100, "b": 58, "c": 50}[part]
        rows.append((i, part, "ft"[t], ["yes"] if (i // 3 * 37 % 100 < tell) == bool(t) else []))
    rows += [(1000 + i, "d", "t", []) for i in range(5)] + [(2000, None, "t", None), (2001, "a", None, ["yes"]), (None, "a", "t", [])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["g"], r["model"]): r for r in probes.gated_probes(df, ["part"], "t", permutations=40, min_n=20).collect()}
    assert {g for g, _ in got} == {"a", "b", "c"}
    for (g, model), r in got.items():
        if r["lift"] > construction.LIFT_FAIL:
            assert r["fails"] and r["p_value"] is None
        elif r["lift"] > construction.LIFT_TEST:
            null = [x["lift"] for x in probes.probe_lifts(df.where(f"part = '{g}'"), ["part"], "t", (model,), shuffles=list(range(1, 41))).collect()]
            assert r["p_value"] == pytest.approx((1 + sum(x >= r["lift"] for x in null)) / 41)
            assert r["fails"] == (r["lift"] > sorted(null)[39])
        else:
            assert not r["fails"] and r["p_value"] is None
    assert got["a", "boosting"]["fails"] and got["a", "logistic"]["fails"] and not got["c", "logistic"]["fails"]
    assert any(r["p_value"] is not None for r in got.values())
    assert probes.gated_probes(df.limit(0), ["part"], "t").count() == 0


def test_queries_by_group(spark, small):
    from credence import plans

    got = plans.queries()["c27_probe_accuracy"](spark, small).collect()
    assert {r["model"] for r in got} == set(probes.MODELS) and all(0 < r["accuracy"] <= 1 for r in got)
    split = plans.queries()["c29_probe_split"](spark, small).collect()
    assert {r["family"] for r in split} == {"words", "options", "labels"} and len({r["source"] for r in split}) > 1
    assert all(r["n"] >= 20 and 0 <= r["accuracy"] <= 1 and (r["p_value"] is None or 0 < r["p_value"] <= 1) for r in split)
