"""Fill-in-middle, token counts and importance resampling against plain versions and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import compare
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from credence.llm import fill_middle, importance, queries, token_counts
from credence.llm.common import documents

SCHEMA = "doc_id long, text string, row long, output string, n long, token string, entries int, stream string, rank long, part int, ids long, extra string"
EXTRA = (1, "o", 2, "t", 3, "s", 4, 5, 6, "e")
TEXTS = [
    (1, None), (2, ""), (3, " \n "), (3, " \n "), (None, "no id, Aé ß 日本語 😀 twenty　words"), (4, "holds <P> a mark"), (5, "holds <M>"), (6, "😀" * 70_000),
    (7, "x" * 300_000), (8, "Word wörd  ▁ two▁three \n\n\n  end " * 20_000), (9, "1\r\n\t\x00a\x85b " * 30), (9, "other text of the same id " * 10), (10, "<s></s><unk>  "),
    (11, "same words of a third of all rows " * 8),
]
ODD = [(k, t, *EXTRA) for k, t in TEXTS] + [(100 + i, "same words of a third of all rows " * 8, *EXTRA) for i in range(7)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=str)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill-in-middle ------------------------------------------------------------------------------------


def plain_fim(key, text):
    t = text or ""
    h = digest(f"1:{'' if key is None else key}")
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(t)
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    if not t or re.search("<[PSM]>", t) or c % 100 >= 90:
        return key, n, "plain", None, None, digest(t), digest(t)
    p, m, s = t[:lo], t[lo:hi], t[hi:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return key, n, form, len(p), len(m), digest(out), digest(t)


@pytest.mark.parametrize("every", [4, 64, 1 << 10])
def test_checkpoints_find_every_cut(every, monkeypatch):
    monkeypatch.setattr(fill_middle, "STRETCH", 100)
    rng = random.Random(every)
    for size in (0, 1, 3, 4, 63, 64, 65, 700):
        text = "".join(rng.choice("aé日😀") for _ in range(size))
        index = fill_middle.Checkpoints(text.encode(), every)
        assert index.n == size
        assert [index.offset(i) for i in range(size + 1)] == [len(text[:i].encode()) for i in range(size + 1)]


def test_fill_in_middle(spark, small, odd):
    for docs in (documents(spark, small), odd):
        expected = sorted((plain_fim(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        assert rows(fill_middle.op11(docs)) == expected
    forms = Counter(r["form"] for r in fill_middle.op11(documents(spark, small)).collect())
    assert set(forms) == {"plain", "psm", "spm"}
    assert fill_middle.op11(odd.limit(0)).count() == 0


def test_all_documents_by_each_form(spark, odd):
    for share, first, form in ((100, 0, "psm"), (100, 100, "spm"), (0, 0, "plain")):
        made = fill_middle.fill_in_middle(odd, "seed", share, first)
        back = made.select("doc_id", "form", fill_middle.restored(made["output"], made["form"]).alias("text"))
        assert rows(back, "doc_id", "text") == sorted(((k, t or "") for k, t, *_ in ODD), key=str)
        assert {r["form"] for r in back.where("length(text) > 100").collect()} <= {form, "plain"}


def test_fill_in_middle_equals_sql(spark, small):
    assert compare.differences(spark, compare.connect(small), queries.queries()["op11_fill_middle"], queries.oracle_sql()["op11_fill_middle"], small) == []


# --- token counts --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pre_tokens_are_counted_as_in_their_text(library):
    with open(token_counts.default_path(), "rb") as f:
        pieces = token_counts.Pieces(f.read())
    rng = random.Random(12)
    parts = ["the", "Ca", " ", "  ", "\n", "▁", "\t", "😀", "é", "12", "<s>", "\x00", "日本", ".", "</s>", "\r\n", "　", "ing", "<0x0A>", "<unk>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    assert [sum(pieces.count(token_counts.pre_tokens(t))) for t in texts] == [len(library.encode(t)) for t in texts]
    assert all("".join(token_counts.pre_tokens(t)) == "▁" + t.replace(" ", "▁") for t in texts if t)
    for size in (1, 3, 10):
        assert [[x for p in token_counts.stretches(t, size) for x in token_counts._PRE_TOKEN.findall(p)] for t in texts] == [token_counts.pre_tokens(t) for t in texts]


@pytest.mark.parametrize("sizes", [{}, {"stretch": 50, "shard": 100}])
def test_token_counts_equal_the_library(spark, small, odd, library, sizes):
    for docs in (documents(spark, small), odd):
        expected = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in docs.collect()), key=str)
        assert rows(token_counts.token_counts(docs, **sizes)) == expected
    assert token_counts.token_counts(odd.limit(0), **sizes).count() == 0


def test_over_limit(spark, odd):
    got = token_counts.op12(odd).collect()
    assert len(got) == len(ODD) and all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got) and {r["over_limit"] for r in got} == {True, False}


def test_pieces_are_counted_once_per_distinct_pre_token(spark, small, monkeypatch):
    """A shard asks the model for each of its distinct pre-tokens once, whatever the chunks that have it."""
    docs = documents(spark, small).repartition(7)
    table = token_counts.chunks(docs)
    assert table.count() == 7
    distinct = {t for r in docs.select("text").collect() for t in token_counts.pre_tokens(r["text"] or "")}
    entries = table.selectExpr("explode(tokens) t").groupBy("t").count().collect()
    assert {r["t"] for r in entries} == distinct and max(r["count"] for r in entries) == 7
    answers = token_counts.piece_counts(table)
    assert answers.selectExpr("sum(length(pieces)) / 4").first()[0] == sum(r["count"] for r in entries)


def test_packed_numbers_come_back():
    for numbers in ([], [0], [1, 255, 256, 70_000, 2**32 - 1]):
        assert token_counts.unpacked(token_counts.packed(np.array(numbers, dtype=np.int64))).tolist() == numbers
    some = ["▁", "\n", "▁▁", "▁x", "\nfoo", "\n", "▁", "▁\x00é"]
    assert token_counts._SENT.findall("".join("\n" + t for t in some)) == some


def test_chunks_close_when_full(monkeypatch):
    monkeypatch.setattr(token_counts, "POINTS", 10)
    chunk = token_counts._Chunk()
    chunk.add((1, 1, 1), token_counts.Counter(["▁ab", "▁cd", "▁ab"]))
    assert not chunk.full() and chunk.points == 6
    chunk.add((2, 2, 2), token_counts.Counter(["▁ab", "▁efg"]))
    assert chunk.full() and chunk.points == 10 and chunk.entries == 4


def test_a_model_whose_pieces_cross_blanks_is_refused(monkeypatch):
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda **_: Crossing())
    with pytest.raises(ValueError):
        token_counts.Pieces(b"")


# --- importance resampling -----------------------------------------------------------------------------


def plain_words(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def plain_features(text, longest=1):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_importance(docs, target, longest=1):
    own, other = Counter(), Counter()
    for _, t in docs:
        own.update(plain_features(t, longest))
    for t in target:
        other.update(plain_features(t, longest))
    s, t = own.total(), other.total()
    gain = [math.floor(1000 * math.log((other[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for key, text in docs:
        f = plain_features(text, longest)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(digest(f"2024:{'' if key is None else key}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(f), weight, score, None, len(plain_words(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for i, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


NAMES = ["doc_id", "n_features", "weight", "score", "rank"]


def test_importance_equals_plain(spark, small, odd):
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    texts = [r["text"] for r in target.collect()]
    for docs in (documents(spark, small), odd):
        pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert rows(importance.resampled(docs, target), *NAMES) == plain_importance(pairs, texts)
    assert rows(importance.op13(spark, small)) == plain_importance([(r["doc_id"], r["text"]) for r in documents(spark, small).collect()], texts)
    assert importance.resampled(odd.limit(0), target).count() == 0
    assert rows(importance.resampled(odd, target.limit(0)), *NAMES) == plain_importance([x[:2] for x in ODD], [])


def test_parts_stretches_and_longer_features(spark, small, odd):
    target = spark.read.parquet(f"{small}/benchmark.parquet").limit(50)
    docs = documents(spark, small).select("doc_id", "text").limit(60).unionByName(odd.select("doc_id", "text"))
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = plain_importance(pairs, [r["text"] for r in target.collect()], 3)
    assert rows(importance.resampled(docs, target, 3), *NAMES) == expected
    for size in (1, 5, 64, 1000):
        text = "Ab  c😀d, " * 9 + "x" * 200 + " é1 " + "y" * 77
        got = [p.split() for p in importance.stretches(text.encode(), size)]
        assert [w.decode() for p in got for w in p] == plain_words(text)
        assert sorted(np.concatenate(list(importance.features(text.encode(), 3, stretch=size))).tolist()) == sorted(plain_features(text, 3))


def test_small_parts_give_the_same(spark, odd):
    """A document cut into many parts, and streams of single documents."""
    whole = rows(importance.gathered(importance.streams(odd, 2), spark.range(10000).selectExpr("int(id) bucket", "id * id % 777 - 300 gain")))
    packed = importance.streams(odd, 2, part=50, stretch=100)
    assert packed.count() > 100
    again = rows(importance.gathered(packed, spark.range(10000).selectExpr("int(id) bucket", "id * id % 777 - 300 gain")))
    assert [r[1:] for r in again] == [r[1:] for r in whole]


def test_counts_by_sorted_runs(spark, odd):
    got = {r["bucket"]: r["n"] for r in importance.bucket_counts(importance.streams(odd)).collect()}
    expected = Counter(b for _, t, *_ in ODD for b in plain_features(t))
    assert got == dict(expected)


def test_ties_rank_by_id(spark):
    made = spark.createDataFrame([(i, i % 50, 7) for i in range(200)], "row long, doc_id long, score long")
    got = sorted((r["rank"], r["doc_id"], r["row"]) for r in importance.drawn(made, made["doc_id"] >= 10, 100).where("rank is not null").collect())
    assert [r[0] for r in got] == list(range(1, 161)) and [r[1:] for r in got] == sorted(r[1:] for r in got)
