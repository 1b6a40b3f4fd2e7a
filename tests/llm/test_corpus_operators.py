"""Fingerprints, near-duplicates, suffix arrays, mixing, toxicity and the pipeline against plain versions."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from credence.llm import components, fingerprints, mixing, quality, secrets, simhash_dedup, suffix_dedup, toxicity
from credence.llm.common import documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, head long, rows long, mix_rate double, h long, fp long, bucket int"
EXTRA = ("k", 1, 2, 3, 0.5, 4, 5, 6)
ODD = [
    (1, None, None, None, None, *EXTRA),
    (2, "", "en", "a", 0, *EXTRA),
    (3, "one two", "en", "a", 7, *EXTRA),
    (3, "one two", "en", "a", 7, *EXTRA),
    (4, "ONE\ttwo", "en", "a", 7, *EXTRA),
    (None, "no id here at all", "en", "b", 17, *EXTRA),
    (5, "x" * 150_000, "en", "b", 150_000, *EXTRA),
    (5, "other text of the same id", "en", "b", 25, *EXTRA),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


# --- fingerprints --------------------------------------------------------------------------------------


def plain_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        a, b, c = map(fingerprints.simhash, (text, changed, following))
        out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), a.hex(), b.hex(), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return sorted(out, key=str)


def plain_simhash(text):
    """Votes bit by bit in whole numbers and floats."""
    import math

    import xxhash

    top = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & top
        x = (x ^ (x >> 31)) * 0xC4CEB9FE1A85EC53 & top
        return x ^ (x >> 33)

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return bytes(16)
    h = [xxhash.xxh64_intdigest(w) for w in words]
    terms = collections.Counter([(a * 0x9E3779B97F4A7C15 + b) & top for a, b in zip(h, h[1:], strict=False)] or h)
    votes = [0.0] * 128
    for t, n in terms.items():
        lanes = mixed(t).to_bytes(8, "little") + mixed((t * 0xC2B2AE3D27D4EB4F + 0x9E3779B97F4A7C15) & top).to_bytes(8, "little")
        for i in range(128):
            votes[i] += (1 + math.log(n)) * (1 if lanes[i // 8] >> (7 - i % 8) & 1 else -1)
    return sum(1 << (127 - i) for i in range(128) if votes[i] > 1e-3).to_bytes(16, "big"), {i for i in range(128) if abs(votes[i]) <= 1e-3}


def test_simhash_equals_plain_votes(spark, small):
    for text in [*(r["text"] or "" for r in documents(spark, small).limit(60).collect()), "", "one", "One TWO one two ONE", "é É é"]:
        got, want = fingerprints.simhash(text), plain_simhash(text)
        if isinstance(want, bytes):
            assert got == want
        else:  # bits whose votes cancel are rounding's
            apart = int.from_bytes(got, "big") ^ int.from_bytes(want[0], "big")
            assert all(not apart >> (127 - i) & 1 for i in range(128) if i not in want[1])


def test_fingerprint_rows(spark, small, odd):
    for docs in (documents(spark, small), odd, odd.where("doc_id = 2")):
        got = sorted((tuple(r)[:7] for r in fingerprints.op5(docs).collect()), key=str)
        assert got == plain_edits([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    assert fingerprints.op5(odd.limit(0)).count() == 0


def test_likeness_tells_edits_from_strangers(spark, small):
    got = fingerprints.op5(documents(spark, small)).where("n_chars > 400").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) / len(got) > 0.97


def test_near_copies_are_counted_and_named(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(12):
        words = [word() for _ in range(60 if k % 2 else 400)]
        rows.append((1000 * k, " ".join(words)))
        rows += [(1000 * k + 1 + i, " ".join(words)) for i in range(k)]  # exact copies
        for i in range(5):  # one changed word each
            changed = list(words)
            changed[rng.randrange(len(words))] = word()
            rows.append((1000 * k + 51 + i, " ".join(changed)))
    rows.append((None, rows[0][1]))
    got = fingerprints.op5(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    for r in got:
        if r["doc_id"] is None or r["doc_id"] % 100:
            assert r["n_near"] is None and r["near"] is None
            continue
        mine = int(r["fingerprint"], 16)
        want = collections.defaultdict(list)
        for o in got:
            want[(mine ^ int(o["fingerprint"], 16)).bit_count(), o["fingerprint"]].append(o["doc_id"])
        want = {k: v for k, v in want.items() if k[0] <= fingerprints.NEAR}
        assert r["near"] == ",".join(f"{d}:{f}:{min(x for x in v if x is not None)}:{len(v)}" for (d, f), v in sorted(want.items()))
        assert r["n_near"] == sum(map(len, want.values())) - 1 == r["doc_id"] // 1000 + 5 + (r["doc_id"] == 0)


def test_wide_radius_finds_all():
    rng = np.random.default_rng(8)
    q = rng.integers(0, 1 << 16, (300, 8), dtype=np.uint16)
    flips = rng.random((300, 20, 128)) < rng.uniform(0, 0.35, (300, 20, 1))
    others = (q[:, None] ^ np.packbits(flips, axis=2).view(np.uint16)).reshape(-1, 8)
    apart = np.bitwise_count(q[:, None] ^ others[None]).sum(axis=2, dtype=int)
    for radius in (0, 3, 15, 31):
        got = [(a, b, d) for x in fingerprints._Tables(q, radius).near(others) for a, b, d in zip(*(y.tolist() for y in x), strict=True)]
        assert sorted(got) == sorted((a, b, apart[a, b]) for a, b in zip(*(y.tolist() for y in np.nonzero(apart <= radius)), strict=True))


def test_block_tables_find_all_in_the_radius(spark):
    rng = random.Random(1)
    values = set()
    for _ in range(20):
        base = rng.getrandbits(128)
        for _ in range(15):
            v = base
            for _ in range(rng.randrange(6)):
                v ^= 1 << rng.randrange(128)
            values.add(v)
    df = spark.createDataFrame([(f"{v:032x}",) for v in values], "fingerprint string")
    got = {r["fingerprint"]: r["n_near"] for r in fingerprints.near_counts(df, df).collect()}
    want = {f"{v:032x}": sum(0 < (v ^ w).bit_count() <= 3 for w in values) for v in values}
    assert got == {k: n for k, n in want.items() if n}
    all_fps = df.withColumn("doc_id", F.lit(1).cast("long"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(fingerprints.near_classes(all_fps, df, asked=40)) == rows(fingerprints.near_classes(all_fps, df))
    assert rows(fingerprints.near_classes(all_fps, df.limit(0))) == []


# --- near-duplicates -----------------------------------------------------------------------------------


def plain_fingerprint(t):
    import re

    import xxhash

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    """(doc_id, fingerprint, smallest reachable id) of (id, text) rows."""
    f = np.array([plain_fingerprint(t) for _, t in rows], dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 3
    label = np.array([k if k is not None else 1 << 60 for k, _ in rows])
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    return sorted(((k, f"{int(x):016x}", None if c == 1 << 60 else int(c)) for (k, _), x, c in zip(rows, f, label, strict=True)), key=str)


@pytest.mark.parametrize("direct", [2048, 1])
def test_near_duplicates(spark, small, odd, direct, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "DIRECT", direct)
    for docs in (documents(spark, small), odd):
        got = sorted(map(tuple, simhash_dedup.op7(docs).collect()), key=str)
        assert got == plain_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert simhash_dedup.op7(odd.limit(0)).count() == 0


@pytest.mark.parametrize("direct", [2048, 1])
def test_links_connect_all_in_the_radius(spark, direct, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "DIRECT", direct)
    rng = random.Random(2)
    values = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(30):
            v = base
            for _ in range(rng.randrange(7)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    v = np.array(sorted(values), dtype=np.uint64)
    df = spark.createDataFrame([(simhash_dedup.signed(int(x)),) for x in v], "fp long")
    got = {r["node"] & (2**64 - 1): r["root"] for r in components.components(simhash_dedup.links(df)).collect()}
    near = np.bitwise_count(v[:, None] ^ v[None]) <= 3
    label = np.arange(len(v))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    mine = [got.get(int(x), int(x)) for x in v]
    assert len(set(mine)) == len(set(label)) == len(set(zip(mine, label, strict=True)))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(7000, 7000)]
    got = components.components(spark.createDataFrame(chain, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1100)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each(spark, odd):
    got = simhash_dedup.one_of_each(odd)
    assert got.columns == odd.columns
    kept = sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=str)
    assert kept == sorted([(1, ""), (3, "one two"), (5, "other text of the same id"), (5, "x" * 150_000), (None, "no id here at all")], key=str)
    rng = random.Random(15)
    texts = [" ".join(rng.choice("abcdefgh") * 4 for _ in range(60)) for _ in range(30)]
    rows = [(rng.choice([None, 7, 8, *range(20, 60)]), rng.choice(texts), str(rng.randrange(3))) for _ in range(300)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["lang"]) for r in simhash_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())
    part = {t: c for t, (_, _, c) in zip(range(30), sorted(plain_components(list(enumerate(texts))), key=lambda r: r[0]), strict=True)}
    assert len(got) == len(set(part.values()))
    for none, i, t, lang in got:
        mates = [(r[0] is None, r[0] or 0) for r in rows if part[texts.index(r[1])] == part[texts.index(t)]]
        assert (none, i) == min(mates) and lang == min(r[2] for r in rows if (r[0] is None, r[0] or 0, r[1]) == (none, i, t))


# --- suffix arrays -------------------------------------------------------------------------------------


def test_two_stage_sort_is_a_sort():
    rng = random.Random(0)
    for _ in range(200):
        alphabet = rng.choice([b"ab", b"a", bytes(range(256)), b"abc"])
        t = bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 120)))
        marked, order = suffix_dedup.two_stage_sort(t, np.ones(len(t), dtype=bool), 400)
        order = [i for i in order if i < len(t)]
        assert sorted(order) == list(range(len(t)))
        assert all(marked[a:] < marked[b:] for a, b in zip(order, order[1:], strict=False))
        shared = suffix_dedup.common_prefixes(marked, order, 400)
        for s, a, b in zip(shared, order, order[1:], strict=False):
            n = 0
            while a + n < len(marked) and b + n < len(marked) and marked[a + n] == marked[b + n]:
                n += 1
            assert s >= min(n, 400) if n else s == 0


def plain_cuts(texts, width):
    seen = collections.defaultdict(list)
    for k, t in enumerate(texts):
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]].append((k, i))
    masks = [np.zeros(len(t) + 1, dtype=np.int64) for t in texts]
    for v in seen.values():
        if len(v) > 1:
            for k, i in v:
                masks[k][i] += 1
                if i + width < len(masks[k]):
                    masks[k][i + width] -= 1
    out = []
    for t, m in zip(texts, masks, strict=True):
        gone = np.cumsum(m)[: len(t)] > 0
        runs = int((gone[1:] & ~gone[:-1]).sum() + (len(gone) > 0 and gone[0]))
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, dtype=np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def plain_passages(texts, width=50):
    seen = collections.Counter()
    words = [t.split() for t in texts]
    for w in words:
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for t, w in zip(texts, words, strict=True):
        inside = np.zeros(len(w) + 1, dtype=bool)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                inside[i : i + width] = True
        out.append((len(t), int((inside[1:] & ~inside[:-1]).sum() + inside[0]), int(inside.sum())))
    return sorted(out)


@pytest.mark.parametrize("large", [None, 1])
def test_repeated_passages(spark, large):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 5)))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 200)]
    made = []
    for i in range(120):
        w = [word() for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            w += rng.choice(passages) + [word() for _ in range(rng.randrange(40))]
        made.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    made += [(200, "of. " * 130), (201, None), (202, "ü " * 60)]
    got = suffix_dedup.op6(spark.createDataFrame(made, "doc_id long, text string"), large).collect()
    texts = [(t or "").encode() for _, t in made]
    assert sorted((r["n_bytes"], r["n_passages"], r["n_passage_words"]) for r in got) == plain_passages(texts)


@pytest.mark.parametrize("large", [None, 1])
def test_suffix_dedup(spark, small, odd, large):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    made = [(i, "".join(rng.choice("stuv ") for _ in range(rng.randrange(500))) + passage[rng.randrange(300) : 600 + rng.randrange(300)] + str(i)) for i in range(60)]
    made += [(100, "a" * 3000), (101, "ab" * 700), (101, "ab" * 700), (102, "é" * 500), (103, "x" * 399), (104, "x" * 400), (105, "abc" * 300 + "a" * 900 + "b" * 401)]
    for docs in (documents(spark, small).limit(80), odd, spark.createDataFrame(made, "doc_id long, text string")):
        texts = [(r["text"] or "").encode() for r in docs.collect()]
        got = suffix_dedup.op6(docs, large).collect()
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_cuts(texts, 400)
        assert sorted((r["n_bytes"], r["n_passages"], r["n_passage_words"]) for r in got) == plain_passages(texts)
    assert suffix_dedup.op6(odd.limit(0)).count() == 0
    assert suffix_dedup.deduplicated(odd).count() == odd.count()


@pytest.mark.parametrize("length", [330, 395, 560])
def test_crowded_groups_are_split(spark, length):
    """A passage in very many documents with other text around it, some of which repeats."""
    rng = random.Random(length)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(length))
    made = []
    for i in range(1200):
        left, right = ("".join(rng.choice("st") for _ in range(rng.choice((5, 70, 200)))) for _ in "ab")
        if i % 10 == 0:
            left, right = left[:30] + "u" * (i % 70), "v" * (i % 90) + right
        made.append((i, left + passage + right))
    texts = [t.encode() for _, t in made]
    got = suffix_dedup.op6(spark.createDataFrame(made, "doc_id long, text string"), 16).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_cuts(texts, 400)


def test_word_hashes():
    import xxhash

    rng = random.Random(5)
    words = [b"a", b"b", b"ab", b"ba", b"x" * 256, b"x" * 257, b"y" * 100_000, "ü".encode(), b"\x00", b"\x00\x00", b"\x1c"]
    of = {}
    for _ in range(30):
        some = [rng.choice(words) for _ in range(rng.randrange(40))]
        data = b"".join(w + rng.choice([b" ", b"\n", b"\t\x0b\x0c\r "]) for w in some)
        got = suffix_dedup.word_hashes(data)
        assert len(got) == len(data.split()) == len(some)
        for w, h in zip(some, got.tolist(), strict=True):
            assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(words)
    assert of[b"y" * 100_000] == xxhash.xxh3_64_intdigest(b"y" * 100_000)
    many = [str(i).encode() for i in range(100_000)]
    assert len(set(suffix_dedup.word_hashes(b" ".join(many)).tolist())) == len(many)
    assert (suffix_dedup.word_hashes(b" ".join(many))[:1000] == suffix_dedup.word_hashes(b" ".join(many[:1000]))).all()


def test_halves_hold_every_window_once():
    rng = random.Random(4)
    for _ in range(50):
        starts = rng.randrange(1, 338)
        off = rng.randrange(starts - 1, 337)
        data = bytes(rng.randrange(256) for _ in range(starts + 399))
        parts, windows = [(data, off, starts, 0, 336, 0)], []
        while parts:
            d, o, s, lo, hi, at = parts.pop()
            if lo == hi:
                assert s == 1 and len(d) == 400
                windows.append(at)
            else:
                parts += [(x[8], x[5], x[6], x[3], x[4], at + x[7]) for x in suffix_dedup.halves(d, o, s, lo, hi, 400)]
        assert sorted(windows) == list(range(starts))


def test_long_texts_in_stretches(monkeypatch):
    rng = random.Random(9)
    t = bytes(rng.choice(b"abcd") for _ in range(9000))
    whole = list(suffix_dedup._anchors(t, 400))
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1000)
    cut = list(suffix_dedup._anchors(t, 400))
    of = lambda parts: {i: p for a, b, *p in parts for i in range(a, b + 1)}
    assert of(whole) == of(cut) and set(of(whole)) == set(range(9000 - 399))


# --- mixing --------------------------------------------------------------------------------------------


def test_mixing_equals_sql(spark, small, odd):
    from credence.llm.queries import oracle_sql

    got = mixing.op4(documents(spark, small))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(oracle_sql()["op4_mixing"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    parts = got.select(F.spark_partition_id().alias("p"), "mix_key").collect()
    for p in {r["p"] for r in parts}:
        keys = [r["mix_key"] for r in parts if r["p"] == p]
        assert keys == sorted(keys)
    assert mixing.mixed(odd).columns == [*odd.columns, "mix_copy", "mix_key"]
    assert mixing.mixed(odd.limit(0)).count() == 0


def test_mixing_meets_target_weights(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mixed(rows, weights={"a": 1, "b": 2, "absent": 5}, total=30_000).groupBy("source").count().collect()}
    assert None not in got and abs(got["a"] - 10_000) < 400 and abs(got["b"] - 20_000) < 600
    whole = mixing.mixed(rows, weights={"a": 1}, total=14_000 * 3).groupBy("doc_id").count().groupBy().agg(F.avg("count"), F.var_pop("count"), F.count("*")).first()
    zeros = 14_000 - whole[2]
    assert abs(zeros / 14_000 - np.exp(-3)) < 0.01  # a Poisson count of mean 3 is 0 that often


def test_high_rates_are_met(spark):
    rows = [(i, f"t{i}", "a" if i == 0 else "b") for i in range(1001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["source"]: r["count"] for r in mixing.mixed(docs, weights={"a": 0.9, "b": 0.1}, total=4000).groupBy("source").count().collect()}
    assert abs(got["a"] - 3600) < 4 * 60 and abs(got["b"] - 400) < 4 * 20
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit(5000.0).alias("rate"))
    n = many.select(mixing.poisson_count(F.col("rate"), "x", F.col("text")).alias("n")).agg(F.avg("n"), F.var_samp("n"), F.count_distinct("n")).first()
    assert abs(n[0] - 5000) < 4 * (5000 / 400) ** 0.5 and 0.6 < n[1] / 5000 < 1.5 and n[2] > 200


def test_many_sources(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).cast("string").alias("source"))
    want = sorted(map(tuple, mixing.mixed(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(map(tuple, mixing.mixed(docs).collect()), key=str) == want


def test_inverse_poisson(spark):
    import math

    us = [0.0, 0.1, 0.3678, 0.3679, 0.5, 0.9, 0.999999, 1 - 2**-52]
    for rate in (0.0, 0.3, 1.0, 7.5, 300.0):
        got = [r["k"] for r in spark.createDataFrame([(u,) for u in us], "u double").select("u", mixing.inverse_poisson(F.col("u"), F.lit(rate)).alias("k")).orderBy("u").collect()]
        for u, k in zip(us[:-1], got, strict=False):
            cdf = lambda n: sum(math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) if rate else float(i == 0) for i in range(n + 1))
            assert cdf(k) >= u - 1e-9 and (k == 0 or cdf(k - 1) <= u + 1e-9)
        assert got == sorted(got)


# --- toxicity ------------------------------------------------------------------------------------------


def test_toxicity_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op3(spark, sf).withColumnRenamed("toxic", "said").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    hit = sum(r["said"] for r in got if r["toxic"] == 1) / sum(r["toxic"] == 1 for r in got)
    wrong = sum(r["said"] for r in got if r["toxic"] == 0) / sum(r["toxic"] == 0 for r in got)
    assert hit > 0.9 and wrong < 0.01
    assert all(r["p_at_least_1"] >= r["p_at_least_2"] >= r["p_at_least_3"] for r in got)
    assert all(abs(r["expected_severity"] - r["p_at_least_1"] - r["p_at_least_2"] - r["p_at_least_3"]) < 1e-9 for r in got)


def test_toxicity_held_out(spark):
    """Labels of three quarters train; the rest are scored."""
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    got = toxicity.grade(docs.join(labels.where(out), "doc_id", "left_semi"), toxicity.fit(docs, labels.where(~out)))
    got = got.withColumnRenamed("toxic", "said").join(labels, "doc_id").collect()
    toxic, clean = ([r for r in got if r["toxic"] == k] for k in (1, 0))
    assert len(toxic) > 20 and len(clean) > 200
    assert sum(r["said"] for r in toxic) / len(toxic) > 0.8
    assert sum(r["said"] for r in clean) / len(clean) < 0.01
    above = sum((t["expected_severity"] > c["expected_severity"]) + 0.5 * (t["expected_severity"] == c["expected_severity"]) for t in toxic for c in clean)
    assert above / (len(toxic) * len(clean)) > 0.93  # area under the ROC curve
    assert {r["grade"] for r in toxic} >= {1, 2, 3}


def test_severity_follows_the_number_of_toxic_words(spark):
    """More and more words of a toxic kind in texts of one length."""
    rng = random.Random(31)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    nasty = ["".join(rng.choice("uvwxyz") for _ in range(6)) for _ in range(30)]
    text = lambda n: " ".join(rng.sample([rng.choice(nasty) for _ in range(n)] + [rng.choice(plain) for _ in range(60 - n)], 60))
    counts = {i: rng.choice([2, 8, 25]) if i % 4 == 0 else 0 for i in range(1600)}
    docs = spark.createDataFrame([(i, text(n)) for i, n in counts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n > 0)) for i, n in counts.items() if i < 1200], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.grade(docs, toxicity.fit(docs, labels)).collect()}
    mean = {n: np.mean([got[i]["expected_severity"] for i in range(1200, 1600) if counts[i] == n]) for n in (0, 2, 8, 25)}
    assert mean[0] < 0.3 < mean[2] < mean[8] < mean[25] and mean[25] > 2.3


def test_ordinal_gradient():
    model = toxicity.OrdinalModel({f"f{i}": i for i in range(6)})
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    score = x @ np.array([2, -1, 0.5, 0, 0, 1])
    grades = np.digitize(score + rng.logistic(size=400), [-1, 1, 3])
    model.fit([(np.arange(6), row) for row in x], grades)
    assert np.all(np.diff(model.cuts) > 0)
    assert np.corrcoef(x @ model.weights, score)[0, 1] > 0.95


def test_toxicity_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.grade(odd, toxicity.fit(odd, none)).collect()
    assert len(got) == odd.count() and all(r["grade"] == 0 and r["expected_severity"] == 0 for r in got)
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.grade(odd, toxicity.fit(odd, labels)).count() == odd.count()
    assert toxicity.grade(odd.limit(0), toxicity.fit(odd.limit(0), labels)).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------


def test_pipeline_equals_plain_stages(spark, small):
    rows = [r.asDict() for r in documents(spark, small).collect()]
    good = [r for r in rows if quality.verdict(quality.measure(r["text"]))[1]]
    part = {k: c for k, _, c in plain_components([(r["doc_id"], r["text"]) for r in good])}
    one = [r for r in good if part[r["doc_id"]] == r["doc_id"]]
    histogram = collections.Counter((s, b) for r in one for _, _, s, b in secrets.candidates(r["text"]))
    cut = secrets.cutoffs([(*k, n) for k, n in histogram.items()])
    masked = [r | {"text": secrets.masked(r["text"], secrets.all_spans(r["text"], cut)[1])} for r in one]
    mixed = mixing.mixed(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], len(r["text"])) for r in masked], "doc_id long, text string, lang string, source string, n_chars long"))
    from tokenizers import Tokenizer

    from credence.llm import bpe

    lib = Tokenizer.from_file(bpe.default_path())
    want = sorted((r["doc_id"], tuple(lib.encode(r["text"], add_special_tokens=False).ids)) for r in mixed.collect())
    got = corpus_pipeline.run(spark, small)
    assert sorted((r["doc_id"], tuple(r["token_ids"])) for r in got.collect()) == want


def test_stages_on_odd_rows(spark, odd, small):
    docs = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == corpus_pipeline.COLUMNS
        out.count()
        assert stage(spark, odd.limit(0), small).count() == 0


def test_queries_are_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
